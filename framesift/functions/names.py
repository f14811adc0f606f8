"""Keys derived from names: prefixes, identifiers, number parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def surgery_type(key: Column) -> Column:
    """The part of a key before its first slash; the whole key without one."""
    return F.substring_index(key, "/", 1)


def uuid(text: Column) -> Column:
    """The first UUID of a text in lower case, null without one."""
    return F.lower(F.regexp_substr(text, F.lit(UUID)))


def prefix_key(name: Column) -> Column:
    """The part of a name before its first underscore, if that isn't empty; else the name."""
    return F.when(F.instr(name, "_") > 1, F.substring_index(name, "_", 1)).otherwise(name)


def video_id(name: Column) -> Column:
    """The first two parts of a name if the second has at most 5 characters, else its prefix key."""
    parts = F.split(name, "_")
    second = F.get(parts, 1)
    return F.when(second.isNotNull() & (F.length(second) <= 5), F.concat_ws("_", F.get(parts, 0), second)).otherwise(prefix_key(name))


def id_variants(name: Column, pair: tuple[str, str] = ("RS", "TL")) -> Column:
    """A name, and the one with the other mark where it begins with one of the pair, a dash or underscore, and digits."""
    one, two = pair
    mark = F.regexp_extract(name, rf"^(?i)({one}|{two})[-_]\d", 1)
    other = F.when(F.upper(mark) == one.upper(), two).otherwise(one)
    return F.when(mark != "", F.array(name, F.concat(other, F.substring(name, F.length(mark) + 1, F.length(name))))).otherwise(F.array(name))


def record_number(name: Column) -> Column:
    """A run of 7 to 9 digits between an underscore and an underscore or slash; null without one."""
    found = F.regexp_extract(name, r"_(\d{7,9})[_/]", 1)
    return F.when(found != "", found)


def trailing_digits(stem: Column) -> Column:
    return F.regexp_substr(stem, F.lit(r"\d+$"))


def alphanumeric(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def without_title(name: Column) -> Column:
    """The name without a final _TITLE_ and number."""
    return F.regexp_replace(name, r"_TITLE_\d+$", "")


def sanitised(name: Column) -> Column:
    """ASCII letters, digits, dots and dashes; anything else becomes one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9.-]+", "_"), "^_+|_+$", "")


def numbered(index: Column, stem: str = "video") -> Column:
    return F.format_string(f"{stem}%02d", index)


def sort_number(name: Column) -> Column:
    """The first number of a name for sorting; names without one come last."""
    return F.coalesce(F.regexp_substr(name, F.lit(r"\d+")).cast("long"), F.lit(10**9))
