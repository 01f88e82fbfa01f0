"""Queries over all rows: ordinals and totals beyond the first 50 hits, and whole sources."""

from symsearch import queries
from tests.oracle import same


def test_all_hits_are_numbered(spark):
    sf_dir = "/root/testdata/sf0.01"
    same(spark, sf_dir, queries.QUERIES["hit_ordinals"], queries.ORACLES["hit_ordinals"])
    rows = queries.QUERIES["hit_ordinals"](spark, sf_dir).collect()
    assert len(rows) > 50 and {r.total for r in rows} == {len(rows)} and {r["index"] for r in rows} == set(range(len(rows)))
    assert [r.total for r in queries.QUERIES["document_count"](spark, sf_dir).collect()] == [len(rows)]


def test_whole_sources_are_combined(spark, sf_dir):
    rows = queries.sym(spark, sf_dir).select("path", "source").collect()
    got = [r.path for r in queries.QUERIES["combined_sources"](spark, sf_dir).collect()]
    assert sorted(got) == sorted({r.path for r in rows} | {r.source for r in rows if r.source})
