"""String rules: labels, paths, templates, truthiness, seeded hashes and formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that title case does not give.
LABELS = {"cpp": "C++", "objc": "Objective-C", "csharp": "C#", "ejs": "EJS", "ets": "ETS", "sql": "SQL", "php": "PHP", "cuda": "CUDA", "dotnet": ".NET"}


def filled(c: Column) -> Column:
    """c, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def is_filled(c: Column) -> Column:
    """Truth of a string: any non-empty one is true, also the text 'false'."""
    return F.coalesce(c != "", F.lit(False))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for c, or c itself."""
    if not table:
        return c
    entries = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(entries, c), c)


def capitalised(c: Column) -> Column:
    """The first letter of every run of word characters in upper case, the rest unchanged."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\w+|\W+)"), F.lit(1)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def label(c: Column, labels: dict[str, str] = LABELS) -> Column:
    entries = F.create_map(*[F.lit(x) for item in labels.items() for x in item])
    return F.when(~is_filled(c), F.lit("unknown")).otherwise(F.coalesce(F.try_element_at(entries, c), capitalised(c)))


def replace_first(c: Column, find: str, put: str) -> Column:
    """c with the first occurrence of find (as it stands) replaced."""
    at = F.instr(c, find)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(put), c.substr(at + len(find), F.length(c)))).otherwise(c)


def replace_first_column(c: Column, find: Column, put: Column) -> Column:
    at = F.locate_column(find, c) if hasattr(F, "locate_column") else F.position(find, c)
    return F.when((F.length(find) > 0) & (at > 0), F.concat(F.substring(c, F.lit(1), at - 1), put, c.substr(at + F.length(find), F.length(c)))).otherwise(c)


def slug(url: Column, host: str = "https://github.com/") -> Column:
    """A repository url without its host and a final .git."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^" + re.escape(host).replace("/", "\\/"), ""), r"\.git$", "")


def after_marker(path: Column, marker: str = "/repo/") -> Column:
    """What follows the first marker, '.' if nothing does."""
    at = F.instr(path, marker)
    rest = path.substr(at + len(marker), F.length(path))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.coalesce(filled(rest), F.lit("."))).otherwise(F.lit("."))


def last_part(path: Column, separator: str = "/") -> Column:
    return F.element_at(F.split(path, separator), -1)


def padded_index(position: Column, width: int = 2) -> Column:
    """A 1-based index from a 0-based position, padded with zeros."""
    text = (position + 1).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def short(c: Column, length: int = 10) -> Column:
    return F.when(is_filled(c), F.substring(c, 1, length)).otherwise(F.lit("—"))


def iso_time(epoch_seconds: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, from seconds since 1970 (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def thousands(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_number(c, 0)).otherwise(F.lit("—"))


def ratio_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f×", c)).otherwise(F.lit("not comparable"))


def seconds_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("—")).when(c < 1, F.format_string("%.3fs", c)).otherwise(F.format_string("%.2fs", c))


_MASK = 0xFFFFFFFF


def multiply32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, unsigned; by halves, so that it stays below 2**53."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF))
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits unsigned, over the characters of a string (code points below 65,536)."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    prime = F.lit(0x01000193).cast("long")
    return F.aggregate(letters, F.lit(0x811C9DC5).cast("long"), lambda h, x: multiply32(h.bitwiseXOR(F.ascii(x).cast("long")), prime))


def mulberry32(seed: Column) -> Column:
    """The first number of the mulberry32 generator for a 32-bit seed, from 0 to 1."""
    a = (seed + F.lit(0x6D2B79F5).cast("long")).bitwiseAND(F.lit(_MASK))
    shifted = lambda x, n: F.shiftrightunsigned(x, n)
    t = multiply32(a.bitwiseXOR(shifted(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = (t + multiply32(t.bitwiseXOR(shifted(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(_MASK)).bitwiseXOR(t)
    return t.bitwiseXOR(shifted(t, 14)) / 4294967296.0


def match_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern)).cast("long")
