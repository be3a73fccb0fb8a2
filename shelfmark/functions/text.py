"""Column expressions on names and descriptions, and helpers for model output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .tags import trimmed


def title(description: Column, name: Column, most: int = 160) -> Column:
    """The first sentence of the description in one line, cut with an ellipsis; else the name; else 'Untitled'."""
    text = trimmed(F.coalesce(description, F.lit("")))
    sentence = F.split(text, r"(?<=[.!?])\s+", 2)[0]
    line = F.trim(F.regexp_replace(sentence, r"\s+", " "))
    cut = F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)
    return F.when(text != "", cut).otherwise(F.coalesce(name, F.lit("Untitled")))


def version_token(value: Column) -> Column:
    """A name with every other character than letters, digits, '.', '_' and '-' as '_', none of '._-' at the ends; 'unknown' if nothing is left."""
    token = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(value, F.lit(""))), r"[^A-Za-z0-9._-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(token == "", "unknown").otherwise(token)


def short_digest(value: Column) -> Column:
    """The first six bytes of the SHA-256 digest in hex."""
    return F.substring(F.sha2(value, 256), 1, 12)


#: Names that say nothing (fixed values: patterns of digests, ids, cameras and times).
NOISY = (
    r"(?i)^[0-9a-f]{16,}$",
    r"(?i)^[a-z0-9+/=]{20,}$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^(img|dsc|dscf|gopr|mvi|vid|pxl|screenshot)[_-]?\d+$",
    r"^\d{8}[_-]?\d{4,6}$",
    r"^\d+$",
)


def filename_hint(name: Column) -> Column:
    """Words of a file name that say something: null for noisy names and such of fewer than two words of three Latin letters.

    Both are told from the words in lower case, joined by single blanks and cut to 80 characters.
    """
    stem = F.regexp_replace(F.regexp_replace(trimmed(name), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    spaced = trimmed(F.regexp_replace(F.regexp_replace(stem, r"[_\-.]", " "), r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))
    words = trimmed(F.substring(F.regexp_replace(spaced, r"[\x{0}-\x{1F}]", ""), 1, 80))
    low = F.lower(words)
    noisy = F.lit(False)
    for pattern in NOISY:
        noisy = noisy | low.rlike(pattern)
    telling = F.size(F.filter(F.split(low, " "), lambda w: F.length(F.regexp_replace(w, "[^a-z]", "")) >= 3))
    return F.when(~noisy & (telling >= 2), words)


def without_controls(value: Column, most: int) -> Column:
    """Control characters as blanks, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(value, r"\p{Cc}", " "), 1, most)


def duration_label(ms: Column) -> Column:
    """m:ss of whole seconds; '0:00' for null and negative durations."""
    s = F.floor(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)) / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def percent_label(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def first_object(raw: str | None) -> str | None:
    """The first balanced JSON object in a text, code fences passed over; null if there is none."""
    text = raw or ""
    start = text.find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    found = text[start : at + 1]
                    try:
                        json.loads(found)
                        return found
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(StringType())
def json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``first_object`` of each text; brace matching is no regular language."""
    for s in texts:
        yield s.map(first_object)
