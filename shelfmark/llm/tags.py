"""Reading tag lists: JSON text to normalised tags, shared by the tag operators."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache


def _no_constant(name: str):
    raise ValueError(name)  # NaN and Infinity are no JSON


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


@lru_cache(maxsize=1 << 16)
def normal_tag(raw: str) -> str:
    """NFC, lower case, no white space of any kind at the ends; '' is no tag."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", raw).lower()).strip()


def tags_of(raw: str | None) -> list[str]:
    """The normalised tags of one ``tags_json`` in order, with repeats.

    Null, empty text, invalid JSON and JSON that is no list hold no tags; list elements that
    are no strings are passed over.
    """
    if not raw:
        return []
    try:
        value = _decode(raw)
    except (ValueError, RecursionError):
        return []
    if not isinstance(value, list):
        return []
    return [t for x in value if isinstance(x, str) and (t := normal_tag(x))]
