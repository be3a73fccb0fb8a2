import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.cooccurrence import cooccurring
from shelfmark.llm.tags import tags_of
from pyspark.sql import functions as F

from shelfmark.llm.term_counts import BURST, BurstTrie, count_terms, merge_subtrees, pack_subtree, tag_counts, unpack_subtree

ODD = [None, "", " ", "no json", "null", "{}", '"x"', "[1, 2]", '["a", 3, null, {"b": 1}]', '["A", " a ", "a\\u00a0", "a\\t"]', '["e\\u0301", "\\u00c9"]', "[NaN]", '["  ", "\\u3000"]', "[" * 5000, '["' + "x" * 200_000 + '"]']


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abc\U0001f600é", max_size=6)))
def test_trie_counts_like_a_counter(terms):
    trie = BurstTrie()
    for t in terms:
        trie.add(t, 1, 1)
    assert {t: o for t, o, _ in trie.items()} == Counter(terms)
    assert trie.size == len(set(terms))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="abc\U0001f600é\ud800", max_size=6), max_size=20), min_size=1, max_size=4))
def test_subtrees_merge_like_counters(lists):
    tries = [BurstTrie() for _ in lists]
    for trie, terms in zip(tries, lists, strict=True):
        for t in terms:
            trie.add(t, 1, 2)
    rows = [list(t.items()) for t in tries]
    assert all(r == sorted(r) for r in rows)
    blobs = [pack_subtree(r) for r in rows if r]
    assert [list(unpack_subtree(b)) for b in blobs] == [r for r in rows if r]
    want = Counter(t for terms in lists for t in terms)
    if blobs:
        assert list(merge_subtrees(blobs)) == [(t, want[t], 2 * want[t]) for t in sorted(want)]


def test_a_long_common_prefix_spreads(spark):
    rows = [json.dumps([f"https://example.org/item/{k}", "a" * (k % 3000 + 1)]) for k in range(20_000)]
    table = spark.createDataFrame([(x,) for x in rows], "tags_json string").repartition(3)
    got = count_terms(table, "tags_json")
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 0.5 * 23_000
    found = {r.term: r.records for r in got.collect()}
    assert len(found) == 23_000 and found["https://example.org/item/7"] == 1 and found["aa"] == 7


def test_trie_bursts():
    trie = BurstTrie()
    terms = [f"same prefix {k}" for k in range(5 * BURST)]
    for t in terms * 2:
        trie.add(t, 2, 1)
    assert {t: (o, r) for t, o, r in trie.items()} == {t: (4, 2) for t in terms}


def test_tags_of_odd_values():
    assert tags_of('["A", " a ", "a\\u00a0", "a\\t"]') == ["a"] * 4
    assert tags_of('["e\\u0301", "\\u00c9"]') == ["é", "é"]
    assert [tags_of(x) for x in ODD[:8]] == [[]] * 8
    assert tags_of("[NaN]") == []


def _rows(n=400):
    rng = random.Random(3)
    vocabulary = [f"tag {k}" for k in range(60)]
    rows = [json.dumps(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 7))) for _ in range(n)]
    return rows + ODD + ['["hot"]'] * n


def _table(spark, rows):
    return spark.createDataFrame([(x, "t", 1, 2) for x in rows], "tags_json string, term string, records int, item_a int")


def test_counts_against_brute_force(spark):
    rows = _rows()
    occurrences, records = Counter(), Counter()
    for x in rows:
        occurrences.update(tags_of(x))
        records.update(set(tags_of(x)))
    for spill in (1_000_000, 5):
        got = {r.term: (r.occurrences, r.records) for r in count_terms(_table(spark, rows), "tags_json", spill_terms=spill).collect()}
        assert got == {t: (occurrences[t], records[t]) for t in occurrences}
    marks = {r.tag: r.mark for r in tag_counts(_table(spark, rows)).collect()}
    for t, n in records.items():
        assert marks[t] == ("common" if n * 10 > len(rows) else "rare" if n <= 2 else "useful")


def test_empty_tables(spark):
    empty = _table(spark, [])
    assert tag_counts(empty).collect() == []
    assert cooccurring(empty, "tags_json").collect() == []


@pytest.mark.parametrize(("heavy", "least"), [(0, 1), (4, 1), (1000, 1), (4, 5)])
def test_pairs_against_brute_force(spark, heavy, least):
    rows = _rows()
    sets = [sorted(set(tags_of(x))) for x in rows]
    n = Counter(t for s in sets for t in s)
    pairs = Counter((a, b) for s in sets for i, a in enumerate(s) for b in s[i + 1 :])
    got = cooccurring(_table(spark, rows), "tags_json", least, heavy).collect()
    assert {(r.item_a, r.item_b): r.n_ab for r in got} == {p: c for p, c in pairs.items() if c >= least}
    for r in got:
        assert (r.n_a, r.n_b, r.n_records) == (n[r.item_a], n[r.item_b], len(rows))
        assert r.lift == pytest.approx(r.n_ab * len(rows) / (r.n_a * r.n_b))


def test_a_record_longer_than_a_piece(spark):
    long = json.dumps([f"t{k:04d}" for k in range(1203)])
    got = cooccurring(_table(spark, [long]), "tags_json", 1, 3)
    assert got.count() == 1203 * 1202 // 2
