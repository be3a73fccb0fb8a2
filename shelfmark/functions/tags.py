"""Column expressions on tag lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADULT = "nsfw"
#: White space of any kind, as a character class of regular expressions (fixed values: the white space of Unicode).
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = f"^{SPACE}+|{SPACE}+$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, _ENDS, "")


def plain(x: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(trimmed(x))


def decoded(tags_json: Column, strict: bool = False) -> Column:
    """The strings of a JSON list; null, '' and bad JSON give the empty list, bad JSON an error with ``strict``."""
    parsed = F.from_json(tags_json, "array<string>")
    strings = F.filter(parsed, lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    if not strict:
        return F.coalesce(strings, none)
    blank = tags_json.isNull() | (tags_json == "") | (tags_json == "null")
    return F.when(blank, none).when(parsed.isNull(), F.raise_error(F.lit("tags_json is no JSON list")).cast("array<string>")).otherwise(strings)


def normalized_tags(tags: Column) -> Column:
    """Trimmed, lower case, blanks gone, the first of equal tags kept."""
    return F.array_distinct(F.filter(F.transform(tags, plain), lambda x: x != ""))


def is_adult(tags: Column) -> Column:
    return F.exists(tags, lambda x: plain(x) == ADULT)


def toggled(tags: Column, target: str = ADULT) -> Column:
    """struct(tags, present): removes every spelling of ``target``, or appends it if there is none."""
    kept = F.filter(F.transform(tags, trimmed), lambda x: x != "")
    there = F.exists(kept, lambda x: F.lower(x) == target.lower())
    after = F.when(there, F.filter(kept, lambda x: F.lower(x) != target.lower())).otherwise(F.concat(kept, F.array(F.lit(target))))
    return F.struct(after.alias("tags"), (~there).alias("present"))


def with_adult_flag(tags: Column, flagged: Column, most: int = 10) -> Column:
    """Generated tags with the adult tag only where flagged, last, and at most ``most`` in all."""
    rest = F.filter(tags, lambda x: plain(x) != ADULT)
    return F.when(flagged, F.concat(F.slice(rest, 1, most - 1), F.array(F.lit(ADULT)))).otherwise(rest)


def matches(tags: Column, required: list[str], match_all: bool) -> Column:
    """Whether normalized ``tags`` hold all or any of ``required``; no requirement matches everything."""
    if not required:
        return F.lit(True)
    wanted = F.array(*[F.lit(t) for t in required])
    mine = normalized_tags(tags)
    return F.size(F.array_except(wanted, mine)) == 0 if match_all else F.arrays_overlap(mine, wanted)


def size_class(count: Column, least: Column, most: Column) -> Column:
    """Display size 1 to 4 of a tag from the place of its count between the least and the most; 2 where all are alike."""
    ratio = (count - least) / F.greatest(F.lit(1), most - least)
    return F.when(most <= least, 2).when(ratio >= 0.75, 4).when(ratio >= 0.45, 3).when(ratio >= 0.2, 2).otherwise(1)


def colour_hash(tag: Column) -> Column:
    """31 * h + character code in unsigned 32 bits, over the characters of the tag."""
    codes = F.transform(F.filter(F.split(tag, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % F.lit(4294967296))
