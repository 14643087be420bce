"""Mode bits, times, names and error classes (OP-H14, OP-H24, OP-H25, OP-H29,
OP-H31, OP-P06)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by the top bits of a mode.
FILE_TYPES = {0o100000: "file", 0o040000: "directory", 0o120000: "symlink", 0o060000: "block", 0o020000: "character", 0o010000: "fifo", 0o140000: "socket"}
# Numbers of common errors and the class they fall into.
ERRORS = {1: "permission", 2: "missing", 5: "io", 13: "permission", 16: "busy", 17: "exists", 20: "not-directory", 21: "is-directory", 22: "invalid", 28: "no-space", 30: "read-only", 36: "name-too-long", 39: "not-empty", 40: "loop", 61: "no-data", 95: "unsupported"}


def lookup(value: Column, names: Mapping[int, str], otherwise: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(otherwise))


def file_type(mode: Column) -> Column:
    return lookup(mode.bitwiseAND(F.lit(0o170000)), FILE_TYPES, "file")


def error_class(number: Column) -> Column:
    return lookup(number, ERRORS, "io")


def cleared_setid(mode: Column, is_directory: Column) -> Column:
    """A write clears setuid and setgid, and sets nothing; directories keep theirs."""
    return F.when(is_directory, mode).otherwise(mode.bitwiseAND(F.lit(~0o6000 & 0o177777)))


def open_request(flags: Column) -> Column:
    """Permission bits that an open with these flags asks for."""
    kind = flags.bitwiseAND(F.lit(3))
    return F.when(kind == 0, 4).when(kind == 1, 2).otherwise(6)


def timestamp_of(seconds: Column) -> Column:
    """Epoch seconds, rounded to microseconds; what is not positive is the epoch."""
    return F.timestamp_micros(F.when(seconds > 0, F.round(seconds * 1_000_000).cast("long")).otherwise(0))


def enum_value(text: Column, names: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """A name in any case, or an alias of it; null for what is neither."""
    known = {n: n for n in names} | dict(aliases or {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(text)))


def mode_of_acl(entries: Column, mode: Column) -> Column:
    """``mode`` with the bits that its list implies: the mask, where there is
    one, stands for the group."""
    first = lambda *tags: F.coalesce(*[F.get(F.transform(_tagged(entries, t), _perms), F.lit(0)) for t in tags])
    bits = lambda shift: F.shiftright(mode, shift).bitwiseAND(F.lit(7))
    owner, group, other = F.coalesce(first("user_obj"), bits(6)), F.coalesce(first("mask", "group_obj"), bits(3)), F.coalesce(first("other"), bits(0))
    kept = mode.bitwiseAND(F.lit(~0o777 & 0o177777))
    return kept.bitwiseOR(F.shiftleft(owner, 6)).bitwiseOR(F.shiftleft(group, 3)).bitwiseOR(other)


def _tagged(entries: Column, tag: str) -> Column:
    return F.filter(entries, lambda e: e["tag"] == tag)


def _perms(entry: Column) -> Column:
    return entry["perms"]


def acl_after_chmod(entries: Column, mode: Column) -> Column:
    """Entries after a change of mode: owner, other, and the mask if there is
    one or else the group."""
    masked = F.exists(entries, lambda e: e["tag"] == "mask")
    bits = lambda shift: F.shiftright(mode, shift).bitwiseAND(F.lit(7))

    def changed(e: Column) -> Column:
        group = ((e["tag"] == "mask") & masked) | ((e["tag"] == "group_obj") & ~masked)
        perms = F.when(e["tag"] == "user_obj", bits(6)).when(e["tag"] == "other", bits(0)).when(group, bits(3)).otherwise(e["perms"])
        return F.struct(e["tag"].alias("tag"), e["id"].alias("id"), perms.alias("perms"))

    return F.transform(entries, changed)


def inherited_acl(default: Column, is_directory: Column) -> Column:
    """struct(access, default) of a new entry: the parent's default list, which
    directories also hand on."""
    return F.struct(default.alias("access"), F.when(is_directory, default).alias("default"))
