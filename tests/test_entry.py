import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["similar_images", "text_search", "tag_cloud", "video_list", "kind_stats", "session_preferences", "buffer_rerank", "video_feedback_queries", "feedback_vectors"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    text = lambda v: None if v is None else repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    mine = sorted(tuple(str(text(r[c])) for c in columns) for r in got.collect())
    rel = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    theirs = sorted(tuple(str(text(v)) for v in r) for r in rel.fetchall())
    assert mine and mine == theirs
