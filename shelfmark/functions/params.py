"""Reading request parameters; plain Python for the driver side."""

from __future__ import annotations

MAX_LIMIT = 200


def _int(raw: str | None) -> int | None:
    try:
        return int((raw or "").strip())
    except ValueError:
        return None


def limit(raw: str | None, default: int) -> int:
    """Out of 1..200, and anything unreadable: the default, not the nearest bound."""
    n = _int(raw)
    return n if n is not None and 1 <= n <= MAX_LIMIT else default


def offset(raw: str | None, most: int = 1_000_000) -> int:
    n = _int(raw)
    return n if n is not None and 0 <= n <= most else 0


def cloud_limit(raw: str | None) -> int:
    return min(limit(raw, 60), 120)


def min_count(raw: str | None, default: int = 1) -> int:
    n = _int(raw)
    return n if n is not None and 1 <= n <= 1000 else default


def flag(raw: str | None) -> bool:
    """The usual spellings of true; everything else is false."""
    return (raw or "") in {"1", "t", "T", "TRUE", "true", "True"}


def order(raw: str | None, default: str, allowed: tuple[str, ...] = ("newest", "random")) -> str:
    s = (raw or "").strip().lower()
    return s if s in allowed else default


def seed(raw: str | None) -> int:
    n = _int(raw)
    return n if n is not None and -(2**63) <= n < 2**63 else 0


def tags(values: list[str]) -> list[str]:
    """Normalized tags of comma-separated values, the first of equal ones kept."""
    found = (t.strip().lower() for v in values for t in v.split(","))
    return list(dict.fromkeys(t for t in found if t))


def tag_filters(tag: list[str], csv: str = "", fallback: str | None = None) -> list[str]:
    """Repeated ``tag`` values and the list ``tags``; ``fallback`` only if these name nothing."""
    found = list(dict.fromkeys([t for t in (x.strip().lower() for x in tag) if t] + tags([csv])))
    return found or tags([fallback or ""])


def seen_ids(raw: str, most: int = 1000) -> list[int]:
    return ids(raw, most)


def ids(raw: str, most: int = 8) -> list[int]:
    """Distinct positive integers of a comma-separated list in order, at most ``most``."""
    found: dict[int, None] = {}
    for x in (raw or "").split(","):
        n = _int(x)
        if n and n > 0:
            found.setdefault(n)
            if len(found) == most:
                break
    return list(found)


def feedback_ids(liked: str, skipped: str) -> tuple[list[int], list[int]]:
    """An id in both lists is liked."""
    a = ids(liked)
    return a, [x for x in ids(skipped) if x not in a]


def search_window(n: int, widened: bool) -> int:
    """Hits to fetch before filters that drop results."""
    return min(n * 8, 200) if widened else n


def video_window(n: int, seen: int) -> int:
    return max(256, min(4000, n * 64 + seen * 8))


def item_id(path: str, prefix: str, action: str | None = None) -> int | None:
    """The id of /prefix/{id} or /prefix/{id}/{action}; null for any other path."""
    if not path.startswith(prefix):
        return None
    parts = path[len(prefix) :].strip("/").split("/") if not path.endswith("//") else []
    if len(parts) != (2 if action else 1) or (action and parts[1] != action):
        return None
    n = _int(parts[0])
    return n if n and n > 0 else None
