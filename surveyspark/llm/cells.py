"""Texts in cells: a bucketed copy that later passes meet without shuffling texts again.

Rows are numbered and laid into cells of at most `CELL_ROWS` neighbouring rows, and written once,
bucketed by cell. What a pass finds about single places goes back to its cell by a co-located
cogroup: only the findings are shuffled, never the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.session import scratch_folder

from .common import id_and_text

#: Rows of a cell, as a power of two.
CELL_BITS = 9


def celled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`(cell, row, doc_id, text)`, written bucketed by cell."""
    spark = df.sparkSession
    rows = id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select(F.shiftright("row", CELL_BITS).alias("cell"), "row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    name = f"cells_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.bucketBy(buckets, "cell").option("path", f"{scratch_folder(spark)}/{name}")
    writer.saveAsTable(name)
    return spark.table(name)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most about `limit` characters of text, one row at least."""
    at, size = 0, 0
    lengths = [len(t) if t is not None else 0 for t in batch.column(column).to_pylist()]
    for k, n in enumerate(lengths):
        if k > at and size + n > limit:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


def found_twice(rows: DataFrame) -> DataFrame:
    """Places `(cell, row, pos)` whose key occurs elsewhere too.

    `rows` has `known, key, check, cell, row, pos`. Tasks settle repeats within what they hold: one
    place stands for all with the flag `known`, so a hot key sends one row per batch; the others
    come with `known` and a key of their own.
    """
    by_key = Window.partitionBy("key", "check")
    twice = rows.withColumn("n", F.count(F.lit(1)).over(by_key)).where("n > 1 or known")
    return twice.select("cell", "row", "pos")


def meet(cells: DataFrame, found: DataFrame, one: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`one(texts, places)` for every cell, co-located by the buckets of the cells."""
    return cells.groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(one, schema)
