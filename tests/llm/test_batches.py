"""Python gets bounded batches, however long the rows are."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rewindle.llm import neighbours
from rewindle.llm.common import small_batches, written


def test_search_takes_few_rows_at_once():
    rows = 2 * neighbours.AT_ONCE + 5
    lists = pa.array([list(range(i % 4)) for i in range(rows)], pa.list_(pa.int64()))
    part = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), lists], ["q", "ws"])
    got = list(neighbours._sliced(iter([part.slice(0, 0), part])))
    assert max(p.num_rows for p in got) == neighbours.AT_ONCE
    assert pa.Table.from_batches(got).to_pylist() == part.to_pylist()


def test_long_lists_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    long = spark.range(300).repartition(1).select(F.sequence(F.lit(0), F.lit(20_000)).alias("h"))

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], ["n", "bytes"])

    with small_batches(spark):
        found = written(long.mapInArrow(sizes, "n long, bytes long"), "sizes")
    row = found.agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).first()
    assert row.n == 300 and row.bytes < 10_000_000
    assert spark.conf.get(name) == before
