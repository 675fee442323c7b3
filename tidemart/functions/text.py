"""Text normalisation, keys and hashes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a null in a surrogate key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"
#: Accents that take a place of their own and separate words.
SPACING_ACCENTS = "¨¯´¸`^"
NON_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def _base_letters() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character and marks, and those bases."""
    pairs = []
    for code in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        if unicodedata.decomposition(chr(code)):
            parts = unicodedata.normalize("NFD", chr(code))
            if parts != chr(code) and unicodedata.category(parts[0]) != "Mn" and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
                pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Letters without their marks; plain ASCII, the usual case, is left as it is."""
    return F.when(contains_non_ascii(text), F.regexp_replace(F.translate(text, *_base_letters()), r"\p{Mn}+", "")).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Accents stripped, lower case, spacing accents as spaces, other non-ASCII gone,
    every run of other characters one space, trimmed; nothing left is null.

    Marks are non-ASCII too, so one pass removes them with all else; accents that are ASCII are no letters anyway.
    """
    source, target = _base_letters()
    spacing = "".join(c for c in SPACING_ACCENTS if ord(c) > 127)
    plain = F.when(contains_non_ascii(text), F.regexp_replace(F.translate(text, source + spacing, target + " " * len(spacing)), f"{NON_ASCII}+", "")).otherwise(text)
    return F.nullif(F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " ")), F.lit(""))


def contains_non_ascii(text: Column) -> Column:
    return text.rlike(NON_ASCII)


def has_mojibake(text: Column) -> Column:
    """Whether non-ASCII characters survive the stripping of accents."""
    return contains_non_ascii(strip_accents(text))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def surrogate_key(*columns: Column) -> Column:
    """md5 over the columns' strings, joined by hyphens, nulls as ``NULL_KEY``."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_KEY)) for c in columns]))


def content_hash(text: Column, version: str, model: str) -> Column:
    """sha256 over text, version and model, joined by NUL."""
    return F.sha2(F.concat(text, F.lit(f"\0{version}\0{model}")), 256)


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of sha256: enough to tell authored versions apart."""
    return F.substring(F.sha2(text, 256), 1, 16)


def strip_fences(text: Column) -> Column:
    """What stands in the first fenced block, or the text without white space around it."""
    fenced = F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.+?)\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


def qualified_name(name: Column) -> Column:
    """The last two parts of a dotted name, in lower case."""
    return F.regexp_extract(F.lower(name), r"(?:[^.]+\.)?[^.]+$", 0)


def human_bytes(n: Column) -> Column:
    """A number of bytes with one decimal and its binary unit."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    written = lambda k: F.format_string(f"%.1f {units[k]}", F.bround(n / F.lit(float(1024**k)), 1))
    out = F.when(n < 1024, written(0))
    for k in range(1, 4):
        out = out.when(n < 1024 ** (k + 1), written(k))
    return out.otherwise(written(4))
