from collections import Counter

import pytest

from symsearch.llm import sharding
from tests.llm.fixtures import empty, odd


def plain_table(shards, slots):
    """The definition, one claim after another."""
    n = sharding._number
    orders = [[(n(s, "offset") % slots + j * (n(s, "stride") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    table = [-1] * slots
    while -1 in table:
        for i, order in enumerate(orders):
            free = next((x for x in order if table[x] < 0), None)
            if free is None:
                break
            table[free] = i
    return table


@pytest.mark.parametrize(("shards", "slots"), [(["a"], 2), (["a", "b", "c"], 13), ([f"s{i}" for i in range(7)], 211)])
def test_table_against_definition(shards, slots):
    assert sharding.lookup_table(shards, slots) == plain_table(shards, slots)


def test_table_is_even_and_changes_little():
    table = sharding.lookup_table(sharding.SHARDS)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.05 * len(table)
    for bad in ((["a", "a"], 13), ([], 13), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    docs = odd(spark)
    got = sharding.place(docs).collect()
    table = sharding.lookup_table(sharding.SHARDS)
    assert len(got) == docs.count()
    assert all(r.shard == sharding.SHARDS[table[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.place(empty(spark)).count() == 0
    again = sharding.place(docs, shard_col="t")
    assert again.columns.count("t") == 1 and sorted(map(str, (r.t for r in again.collect()))) == sorted(r.shard for r in got)
    sharding.write_shards(docs, str(tmp_path / "out"), parts=2)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r.doc_id), r.shard) for r in again.collect()) == sorted((str(r.doc_id), r.shard) for r in got)


def test_tables_are_cleared(spark):
    from symsearch.llm import common

    df = common.written(spark.range(3).toDF("a"), "some")
    assert df.count() == 3
    common.clear_tables(spark)
    assert not spark.sparkContext._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()
