"""Helpers the corpus operators share: stage tables, texts, Arrow loops, connected components."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.session import scratch_folder

#: White space of the word rules: blank and the controls 9 to 13, as a regular expression class.
BLANK = r"[\x20\x09-\x0D]"
#: The same characters as plain text, for trimming.
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the stage tables behind `df`, which nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or it with underscores behind where `df` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` with a number per row in a column of a free name; written once, so numbers stay."""
    name = free_name(df, "_row")
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def only(rows: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """The numbered rows whose number is in the one column of `kept`, without the number."""
    return rows.join(kept.toDF(name), name, "left_semi").drop(name)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so other columns cannot clash with its own."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def per_text(
    df: DataFrame,
    schema: str,
    one: Callable[[str | None], tuple],
) -> DataFrame:
    """`doc_id` and what `one(text)` returns for every row; batches stay Arrow, rows stay in place."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    made = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [one(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*values)) if values else [()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links `(a, b)` of longs: rows `(node, root)`, root the least node.

    Large-star and small-star rounds: every node hands its greater neighbours to its least one,
    then its lesser neighbours to the least of them. Minima are combined before they are shuffled,
    and rounds end when the links no longer change. Links are only ever rewritten, never multiplied.
    """
    links = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links, before = written(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links)
        links = after
        if state == before:
            break
        before = state
    tree = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def hex64(column: Column) -> Column:
    """A long as 16 lower-case hex digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages: it does when the driver's JVM collects garbage."""
    for _ in range(2):  # the first round frees the plans, the second the shuffles they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
