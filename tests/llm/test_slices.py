"""Batches are cut, and a worker keeps the tables of one stage."""

import pyarrow as pa

from turnlake.llm import common


def test_slices():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (0, 3, common.SLICE * 2 + 1)]
    got = list(common.slices(iter(batches)))
    assert [b.num_rows for b in got] == [3, common.SLICE, common.SLICE, 1]
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(3), *range(common.SLICE * 2 + 1)]


def test_tables_of_one_stage():
    one = common.worker_table("one", dict)
    assert list(common.slices(iter([]), "one")) == [] and common.worker_table("one", dict) is one
    assert list(common.slices(iter([]))) == [] and common.worker_table("one", dict) is not one


def test_batch_rows_follow_the_session(spark):
    own = spark.conf.get(common._ROWS)
    try:
        spark.conf.set(common._ROWS, "77")
        common.small_batches(spark)
        assert spark.conf.get(common._ROWS) == "77"
    finally:
        spark.conf.set(common._ROWS, own)
