"""Access checks over mode bits and access-control lists (OP-H09, OP-H11,
OP-H12, OP-W16, OP-A26, OP-F15, OP-J24).

An identity is a uid and an array of gids. POSIX entries are an array of
struct(tag, id, perms); NFSv4 entries of struct(type, principal, flags, bits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READ, WRITE, EXECUTE = 4, 2, 1

# Permission names and the bit they stand for.
PERMISSIONS = {
    "r": READ, "read": READ, "read-data": READ, "list-directory": READ,
    "w": WRITE, "write": WRITE, "write-data": WRITE, "append-data": WRITE, "add-file": WRITE, "add-subdirectory": WRITE,
    "x": EXECUTE, "execute": EXECUTE,
}


def permission_bits(names: Column) -> Column:
    bits = F.create_map(*[F.lit(x) for pair in PERMISSIONS.items() for x in pair])
    return F.aggregate(names, F.lit(0), lambda a, n: a.bitwiseOR(F.coalesce(F.try_element_at(bits, n), F.lit(0))))


def _all(perms: Column, requested: Column) -> Column:
    return perms.bitwiseAND(requested) == requested


def mode_access(mode: Column, owner: Column, group: Column, uid: Column, gids: Column, requested: Column) -> Column:
    own, of_group = F.shiftright(mode, 6), F.shiftright(mode, 3)
    perms = F.when(uid == owner, own).when(F.array_contains(gids, group), of_group).otherwise(mode).bitwiseAND(F.lit(7))
    return _all(perms, requested)


def _first(entries: Column, keep) -> Column:  # type: ignore[no-untyped-def]
    return F.get(F.transform(F.filter(entries, keep), lambda e: e["perms"]), F.lit(0))


def posix_access(
    entries: Column, mode: Column, owner: Column, group: Column, uid: Column, gids: Column, requested: Column
) -> Column:
    """Owner (mask does not apply), named user, any matching groups joined, other."""
    mask = F.coalesce(_first(entries, lambda e: e["tag"] == "mask"), F.lit(7))
    bits = lambda shift: F.shiftright(mode, shift).bitwiseAND(F.lit(7))
    owner_perms = F.coalesce(_first(entries, lambda e: e["tag"] == "user_obj"), bits(6))
    named = _first(entries, lambda e: (e["tag"] == "user") & (e["id"] == uid))
    own_group = F.when(
        F.array_contains(gids, group), F.coalesce(_first(entries, lambda e: e["tag"] == "group_obj"), bits(3))
    )
    groups = F.transform(
        F.filter(entries, lambda e: (e["tag"] == "group") & F.coalesce(F.array_contains(gids, e["id"]), F.lit(False))),
        lambda e: e["perms"],
    )
    joined = F.aggregate(groups, F.coalesce(own_group, F.lit(0)), lambda a, p: a.bitwiseOR(p))
    matched = own_group.isNotNull() | (F.size(groups) > 0)
    other = F.coalesce(_first(entries, lambda e: e["tag"] == "other"), bits(0))
    return (
        F.when(uid == owner, _all(owner_perms, requested))
        .when(named.isNotNull(), _all(named.bitwiseAND(mask), requested))
        .when(matched, _all(joined.bitwiseAND(mask), requested))
        .otherwise(_all(other, requested))
    )


def principal_matches(principal: Column, owner: Column, group: Column, uid: Column, gids: Column) -> Column:
    return (
        (principal == "EVERYONE@")
        | ((principal == "OWNER@") & (uid == owner))
        | ((principal == "GROUP@") & F.array_contains(gids, group))
        | (principal == F.concat(F.lit("uid:"), uid.cast("string")))
        | F.exists(gids, lambda g: principal == F.concat(F.lit("gid:"), g.cast("string")))
    )


def nfs4_access(entries: Column, owner: Column, group: Column, uid: Column, gids: Column, requested: Column) -> Column:
    """Entries in order; each that matches decides bits still asked for. Null
    if there are no entries, so that other rules can apply."""
    live = F.filter(
        entries,
        lambda e: ~F.array_contains(e["flags"], "inherit-only")
        & principal_matches(e["principal"], owner, group, uid, gids),
    )
    start = F.struct(requested.alias("left"), F.lit(None).cast("boolean").alias("verdict"))

    def step(held: Column, e: Column) -> Column:
        hit = e["bits"].bitwiseAND(held["left"])
        left = held["left"].bitwiseAND(F.bitwise_not(hit))
        granted = F.when(left == 0, F.lit(True))
        verdict = F.when(e["type"] == "deny", F.lit(False)).otherwise(granted)
        done = held["verdict"].isNotNull() | (hit == 0)
        return F.when(done, held).otherwise(F.struct(left.alias("left"), verdict.alias("verdict")))

    decided = F.aggregate(live, start, step, lambda held: F.coalesce(held["verdict"], F.lit(False)))
    return F.when(F.size(entries) > 0, decided)


def access(
    kind: Column, mode: Column, owner: Column, group: Column, nfs4: Column, posix: Column, uid: Column, gids: Column, requested: Column
) -> Column:
    """Root rule, then NFSv4, then POSIX, then mode bits."""
    root = (requested.bitwiseAND(F.lit(EXECUTE)) == 0) | (kind == "directory") | (mode.bitwiseAND(F.lit(0o111)) != 0)
    listed = F.coalesce(
        nfs4_access(nfs4, owner, group, uid, gids, requested),
        F.when(F.size(posix) > 0, posix_access(posix, mode, owner, group, uid, gids, requested)),
        mode_access(mode, owner, group, uid, gids, requested),
    )
    return F.when(uid == 0, root).otherwise(listed)


def sticky_allows(mode: Column, parent_owner: Column, child_owner: Column, uid: Column) -> Column:
    return (mode.bitwiseAND(F.lit(0o1000)) == 0) | (uid == 0) | (uid == parent_owner) | (uid == child_owner)


# Tags of the text form, without and with a qualifier.
TEXT_TAGS = {"user": ("user_obj", "user"), "u": ("user_obj", "user"), "group": ("group_obj", "group"), "g": ("group_obj", "group"), "mask": ("mask", "mask"), "m": ("mask", "mask"), "other": ("other", "other"), "o": ("other", "other")}


def parse_acl_text(spec: Column) -> Column:
    """Entries of ``user::rwx,user:1000:r-x,...`` in order; an unknown tag is null."""
    plain = F.create_map(*[F.lit(x) for k, (a, _) in TEXT_TAGS.items() for x in (k, a)])
    named = F.create_map(*[F.lit(x) for k, (_, b) in TEXT_TAGS.items() for x in (k, b)])
    items = F.filter(F.transform(F.split(spec, ","), F.trim), lambda s: s != "")

    def entry(item: Column) -> Column:
        cells = F.split(item, ":")
        tag, who, perms = F.get(cells, F.lit(0)), F.get(cells, F.lit(1)), F.coalesce(F.get(cells, F.lit(2)), F.lit(""))
        bits = F.lit(0)
        for letter, bit in (("r", READ), ("w", WRITE), ("x", EXECUTE)):
            bits = bits + F.when(perms.contains(letter), bit).otherwise(0)
        bare = F.coalesce(who, F.lit("")) == ""
        name = F.when(bare, F.try_element_at(plain, tag)).otherwise(F.try_element_at(named, tag))
        return F.struct(name.alias("tag"), who.try_cast("long").alias("id"), bits.alias("perms"))

    return F.transform(items, entry)


def acl_problems(entries: Column) -> Column:
    """What a POSIX list breaks, in a fixed order; empty for a valid one."""
    count = lambda tag: F.size(F.filter(entries, lambda e: e["tag"] == tag))
    ids = lambda tag: F.transform(F.filter(entries, lambda e: e["tag"] == tag), lambda e: e["id"])
    named = count("user") + count("group")
    found = [F.when(count(t) != 1, F.lit(f"one {t} needed")) for t in ("user_obj", "group_obj", "other")]
    found.append(F.when(count("mask") > 1, "more than one mask"))
    found += [F.when(F.size(F.array_distinct(ids(t))) != F.size(ids(t)), F.lit(f"{t} repeated")) for t in ("user", "group")]
    found.append(F.when((named > 0) & (count("mask") == 0), "mask needed"))
    return F.array_compact(F.array(*found))


# Tags of the binary form, and the id that stands for none.
BINARY_TAGS = {"user_obj": 1, "user": 2, "group_obj": 4, "group": 8, "mask": 16, "other": 32}
BINARY_VERSION, NO_ID = 2, 0xFFFFFFFF


def _little(value: Column, size: int) -> Column:
    """Hexadecimal digits of a number in ``size`` bytes, lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * n).bitwiseAND(F.lit(255))), 2, "0") for n in range(size)])


def _number(digits: Column, at: Column | int, size: int) -> Column:
    first = lambda n: F.substring(digits, F.lit(at) + 1 + 2 * n, F.lit(2)) if isinstance(at, int) else F.substring(digits, at + (1 + 2 * n), F.lit(2))
    return F.conv(F.concat(*[first(n) for n in reversed(range(size))]), 16, 10).cast("long")


def acl_to_binary(entries: Column) -> Column:
    """Version, then tag, bits and id of each entry, lowest bytes first."""
    tags = F.create_map(*[F.lit(x) for pair in BINARY_TAGS.items() for x in pair])

    def packed(e: Column) -> Column:
        tag = F.element_at(tags, e["tag"]).cast("long")
        return F.concat(_little(tag, 2), _little(e["perms"].cast("long"), 2), _little(F.coalesce(e["id"], F.lit(NO_ID)).cast("long"), 4))

    return F.unhex(F.concat(_little(F.lit(BINARY_VERSION).cast("long"), 4), F.array_join(F.transform(entries, packed), "")))


def acl_from_binary(value: Column) -> Column:
    """Entries of the binary form; null for another version or a broken length."""
    digits = F.hex(value)
    count = (F.octet_length(value) / 8).cast("int")
    names = F.create_map(*[F.lit(x) for k, v in BINARY_TAGS.items() for x in (v, k)])

    def entry(n: Column) -> Column:
        at = F.lit(8) + n * 16
        who = _number(digits, at + 8, 4)
        return F.struct(
            F.try_element_at(names, _number(digits, at, 2).cast("int")).alias("tag"),
            F.when(who != NO_ID, who).alias("id"),
            _number(digits, at + 4, 2).cast("int").alias("perms"),
        )

    none = F.array().cast("array<struct<tag:string,id:bigint,perms:int>>")
    held = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry)).otherwise(none)
    whole = (F.octet_length(value) % 8 == 4) & (_number(digits, 0, 4) == BINARY_VERSION)
    return F.when(whole, held)
