"""Ordered work (lag, running totals, exact quantiles) on groups of any size.

A window function sorts a whole group in one task. That is the best plan while groups are
bounded, so the size of the largest group is measured first. Past the bound the rows are
range-partitioned on (keys, order), every slice becomes a chunk of its own, and a one-row
summary per chunk carries the state across the cuts. Results are the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

GROUP_ROWS = 1_000_000
CHUNK = "_chunk"


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of the whole table (one map-side combined count)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = sizes.agg(F.max("_n"), F.sum("_n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & left[key].eqNullSafe(right[key])
    return match


@dataclass(frozen=True)
class Arranged:
    """Rows ordered within their groups; `chunk` names the cut when a group was too large."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    rows: int
    chunk: str | None = None

    @property
    def parts(self) -> list[str]:
        return self.keys + ([self.chunk] if self.chunk else [])

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _with_carry(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """Attach the one-row-per-chunk summary to its rows."""
        renamed = summary.select(
            *[F.col(c).alias(f"_k_{c}") for c in self.parts],
            *[c for c in summary.columns if c not in self.parts],
        )
        match = F.lit(True)
        for c in self.parts:
            match = match & df[c].eqNullSafe(renamed[f"_k_{c}"])
        return df.join(renamed, match, "left").drop(*[f"_k_{c}" for c in self.parts])

    def lag(self, **columns: Column) -> Arranged:
        """Values of the previous row of the group; null on the first row."""
        window = self.window()
        shifted = {name: F.lag(value).over(window) for name, value in columns.items()}
        if not self.chunk:
            return replace(self, df=self.df.withColumns(shifted))
        tail = F.struct(*[value.alias(name) for name, value in columns.items()])
        across = Window.partitionBy(*self.keys).orderBy(self.chunk)
        carry = (
            self.df.groupBy(*self.parts)
            .agg(F.max_by(tail, F.struct(*self.order)).alias("_tail"))
            .withColumn("_tail", F.lag("_tail").over(across))
        )
        inside = self.df.withColumns(shifted).withColumn("_nth", F.row_number().over(window))
        joined = self._with_carry(inside, carry)
        filled = {
            name: F.when(F.col("_nth") == 1, F.col(f"_tail.{name}")).otherwise(F.col(name))
            for name in columns
        }
        return replace(self, df=joined.withColumns(filled).drop("_nth", "_tail"))

    def running_sum(self, *, totals: bool = False, **columns: Column) -> Arranged:
        """Inclusive running sums; with `totals`, also `<name>_total` of the whole group."""
        upto = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*self.keys)
        sums = {name: F.coalesce(F.sum(value).over(upto), F.lit(0)) for name, value in columns.items()}
        if not self.chunk:
            added = dict(sums)
            if totals:
                added |= {f"{n}_total": F.sum(v).over(whole) for n, v in columns.items()}
            return replace(self, df=self.df.withColumns(added))
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(self.chunk)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = self.df.groupBy(*self.parts).agg(
            *[F.sum(value).alias(f"_s_{name}") for name, value in columns.items()]
        )
        carried = {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)) for n in columns}
        if totals:
            carried |= {f"{n}_total": F.sum(f"_s_{n}").over(whole) for n in columns}
        summary = summary.withColumns(carried).drop(*[f"_s_{n}" for n in columns])
        joined = self._with_carry(self.df.withColumns(sums), summary)
        shifted = {n: F.col(n) + F.col(f"_b_{n}") for n in columns}
        return replace(self, df=joined.withColumns(shifted).drop(*[f"_b_{n}" for n in columns]))

    def index(self, name: str) -> Arranged:
        """Position of the row in its group, from zero."""
        out = self.running_sum(**{name: F.lit(1).cast("bigint")})
        return replace(out, df=out.df.withColumn(name, F.col(name) - 1))

    def rolling(self, before: int, after: int, build) -> Arranged:
        """Fixed row frames: `build(frame_window)` returns the columns to add.

        Chunked groups are re-cut into blocks of equal size with a halo of neighbouring rows,
        so a frame never needs a row from another task.
        """
        if not self.chunk:
            return replace(
                self, df=self.df.withColumns(build(self.window().rowsBetween(-before, after)))
            )
        indexed = self.index("_at").df
        block = F.floor(F.col("_at") / F.lit(self.rows))
        first = F.floor((F.col("_at") - after) / F.lit(self.rows))
        last = F.floor((F.col("_at") + before) / F.lit(self.rows))
        spread = indexed.withColumn("_home", block).withColumn(
            "_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))
        )
        window = Window.partitionBy(*self.keys, "_block").orderBy("_at").rowsBetween(-before, after)
        out = spread.withColumns(build(window)).where("_block = _home")
        return replace(self, df=out.drop("_at", "_home", "_block"))

    def done(self) -> DataFrame:
        return self.df.drop(self.chunk) if self.chunk else self.df


def arrange(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    group_rows: int | None = None,
    position: str | None = None,
    measure: DataFrame | None = None,
) -> Arranged:
    """Prepare ordered work on `df`; `order` must be unique within a group.

    `position` names a dense 0-based counter of the group when there is one: chunks are then
    cut from it and no range partitioning is needed. `measure` may be a cheaper table with
    groups at least as large, used for the size check instead of `df`.
    """
    limit = group_rows or GROUP_ROWS
    largest, total = group_sizes(df if measure is None else measure, keys)
    if largest <= limit:
        return Arranged(df, keys, order, limit)
    if position is not None:
        cut = df.withColumn(CHUNK, F.floor(F.col(position) / F.lit(limit)))
        return Arranged(cut, keys, order, limit, CHUNK)
    partitions = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // limit)
    )
    ranged = df.repartitionByRange(partitions, *keys, *order)
    return Arranged(
        checkpointed(ranged.withColumn(CHUNK, F.spark_partition_id())), keys, order, limit, CHUNK
    )


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probabilities: dict[str, float],
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group; equal values are counted before any shuffle."""
    counted = (
        df.select(*keys, value.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = (
        arrange(counted, keys, ["_v"], group_rows=group_rows)
        .running_sum(_cum=F.col("_c"), totals=True)
        .done()
    )
    picks = []
    for name, q in probabilities.items():
        at = F.lit(float(q)) * (F.col("_cum_total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_cum") > place) & (F.col("_cum") - F.col("_c") <= place)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )


def aggregate_with_quantiles(
    df: DataFrame,
    keys: list[str],
    sums: list[Column],
    wanted: dict[str, tuple[Column, float]],
    *,
    group_rows: int | None = None,
    measure: DataFrame | None = None,
    measure_keys: list[str] | None = None,
) -> DataFrame:
    """One aggregation with exact quantiles beside ordinary aggregates.

    `percentile` keeps every distinct value of a group in one buffer, so it is used only when
    the measured groups are bounded; otherwise each quantile is found by `quantiles`.
    """
    limit = group_rows or GROUP_ROWS
    largest, _ = group_sizes(df if measure is None else measure, measure_keys or keys)
    if largest <= limit:
        exact = [F.percentile(value, F.lit(q)).alias(name) for name, (value, q) in wanted.items()]
        return df.groupBy(*keys).agg(*sums, *exact)
    out = df.groupBy(*keys).agg(*sums)
    for name, (value, q) in wanted.items():
        side = quantiles(df, keys, value, {name: q}, group_rows=group_rows)
        renamed = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], name)
        match = F.lit(True)
        for k in keys:
            match = match & out[k].eqNullSafe(renamed[f"_k_{k}"])
        out = out.join(renamed, match, "left").drop(*[f"_k_{k}" for k in keys])
    return out
