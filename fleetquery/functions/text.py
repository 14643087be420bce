"""Paths, sizes, numbers and names (OP-H06, OP-H07, OP-H08, OP-H16, OP-H19,
OP-H26, OP-H28, OP-F08, OP-F14, OP-O05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_parts(path: Column) -> Column:
    """Components of a path after ``.`` and ``..`` have taken effect."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def walk(held: Column, part: Column) -> Column:
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    return F.aggregate(parts, empty, walk)


def clean_path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(path_parts(path), "/"))


def parent_path(path: Column) -> Column:
    """Null for the root."""
    parts = path_parts(path)
    up = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    return F.when(F.size(parts) > 0, up)


def base_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def path_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


# Suffixes of sizes.
SIZE_UNITS = {
    "": 1, "b": 1,
    "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12,
    "ki": 2**10, "kib": 2**10, "mi": 2**20, "mib": 2**20, "gi": 2**30, "gib": 2**30, "ti": 2**40, "tib": 2**40,
}


def parse_byte_size(text: Column) -> Column:
    """Bytes of sizes like ``64KiB``; null for what is no size or too large."""
    trimmed = F.trim(text)
    number = F.replace(F.regexp_extract(trimmed, "^([0-9_]*)", 1), F.lit("_"), F.lit(""))
    suffix = F.lower(F.trim(F.regexp_extract(trimmed, "^[0-9_]*(.*)$", 1)))
    units = F.create_map(*[F.lit(x) for k, v in SIZE_UNITS.items() for x in (k, v)]).cast("map<string,bigint>")
    value = F.when(number != "", number).try_cast("long")
    product = F.try_multiply(value, F.try_element_at(units, suffix))
    return F.when(F.trim(text) != "", product)


def parse_auto_int(text: Column) -> Column:
    """0x hexadecimal, 0o octal, three or more octal digits octal, else decimal."""
    t = F.trim(text)
    octal = F.conv(F.regexp_replace(t, "^0o", ""), 8, 10)
    is_octal = t.rlike("^0o[0-7]+$") | t.rlike("^[0-7]{3,}$")
    parsed = (
        F.when(t.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 64), 16, 10))
        .when(is_octal, octal)
        .when(t.rlike(r"^\+?[0-9]+$"), F.regexp_replace(t, r"^\+", ""))
    )
    return parsed.try_cast("long")


def escape_label(value: Column) -> Column:
    """A label value of the metrics text format."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def snapshot_name(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9._-]", "_")


def is_entry_name(name: Column) -> Column:
    """A name that a directory can hold: 1 to 255 bytes, no slash, no NUL."""
    fits = F.octet_length(name).between(1, 255) & ~name.isin(".", "..")
    return fits & ~name.contains("/") & ~F.contains(name, F.char(F.lit(0)))


BOOT_NAMES = ("boot", "etc", "bin", "sbin", "lib", "lib64", "usr", "init")


def is_boot_name(name: Column) -> Column:
    return name.isin(*BOOT_NAMES)


XATTR_SPACES = ("user", "trusted", "security", "system")


def xattr_space(name: Column) -> Column:
    """Namespace of an extended attribute; null if it has none that is known."""
    return F.coalesce(*[F.when(name.startswith(f"{s}."), F.lit(s)) for s in XATTR_SPACES])


def ratio_text(value: Column) -> Column:
    """A ratio with fewer digits the larger it is."""
    return (
        F.when(value.isNull(), "n/a")
        .when(value >= 100, F.format_string("%.0fx", value))
        .when(value >= 10, F.format_string("%.1fx", value))
        .otherwise(F.format_string("%.2fx", value))
    )


def thousands(value: Column) -> Column:
    """A whole number with a comma between groups of three digits."""
    return F.format_number(value, 0)


def align_up(value: Column, block: int) -> Column:
    return align_down(value + (block - 1), block)


def align_down(value: Column, block: int) -> Column:
    return value - F.pmod(value, F.lit(block))
