"""Some registered queries against their SQL; oracle_check.py compares them all."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["decisions_by_language", "t18_redact_text", "m02_match_lexicon_join", "a14_validate_examples", "a19_cache_hits", "d05_stratified_split", "s10_flatten_threads"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got, want, *_ = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unique_texts_equal_sql_where_cut_texts_clash(spark, tmp_path):
    """Copies of long texts that differ behind the cut only; the first number of one of them is taken as given."""
    import duckdb

    long = "z" * 280
    texts = [f"{long}{k}" for k in range(4)] * 3 + ["a", "a", None, None]
    run, sql = entry.queries()["d07_uniquify_text"], entry.oracle_sql()["d07_uniquify_text"]
    for more in ([], ["taken"]):
        if more:
            more = [r.text for r in first if r.comment_id in (4, 8)]  # what copies became is given here
        rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts + more + more)]
        sf = str(tmp_path / f"sf{len(more)}")
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        con = duckdb.connect()
        for name in ("documents", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
        first = run(spark, sf).collect()
        want = con.execute(sql).fetchall()
        assert sorted(map(tuple, first)) == sorted(want)
        given = [r.text for r in first if r.text is not None]
        assert len(set(given)) == len(given) == len(rows) - 2
