"""Quality rules: robust multivariate outliers by minimum covariance determinant, in SQL expressions.

Every text gets counts (words, symbols, repeated lines and 8-word windows, capitals). Transformed
shares form a vector per document. Per language and source the location and scatter of the cleaner
part of the vectors are estimated by minimum covariance determinant: several starts, then
concentration steps that keep the rows nearest to the present estimate, then the start with the
least determinant, rescaled and reweighted. Documents beyond a Mahalanobis distance are rejected.

The steps run for all groups and starts at once. A step is one join with the small table of
estimates and one combined aggregation of moments by group, start and distance bin, so a hot group
costs each task its own rows only and nothing of a group is gathered. Bins are sixteenths of a
doubling, so a subset holds the wanted share of rows or slightly more. Groups with fewer than
`least_rows` rows share the estimate of their language, or of the whole table: of all its rows, those of
the groups with an estimate of their own included. Variances have
floors (`FLOORS`), so a statistic that is constant in a group does not make the scatter singular.

Edge cases: null and empty texts have no words and fail the base rule; null language or source is a
group of its own; repeated rows count as often as they occur; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, discard, written

#: Words of a window that may not repeat.
RUN = 8
#: The vector: mean word length, symbols, repeated lines, repeated windows, capitals, words said twice running.
AXES = ("v_length", "v_symbols", "v_lines", "v_repeats", "v_capitals", "v_twins")
#: Least standard deviation of each axis, in its own unit.
FLOORS = (0.12, 0.08, 0.15, 0.15, 0.10, 0.10)
#: Share of a group's rows that an estimate rests on.
SUBSET = 0.6
STEPS = 5
#: Rejected beyond this squared distance, about the 1 - 3e-6 quantile of chi-square with six degrees.
CUTOFF = 36.0
#: Median and 97.5 % quantile of chi-square with six degrees.
CHI_MEDIAN, CHI_WEIGHT = 5.348, 14.449
#: Rows from which a group has its own estimate.
LEAST_ROWS = 60
STARTS = 4


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """Counts of every whole text, with built-in expressions only."""
    rows = df.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(BLANK_CHARS))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_capitals": F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long"),
            "n_twins": F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long"),
            "lines": F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(BLANK_CHARS)) != ""),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        }
    ).drop("words", "text")
    for step in (1, 2, 4):  # hashes of 2, then 4, then 8 words in a row
        rows = rows.withColumn("hashes", F.transform("hashes", _with_next(step)))
    rows = rows.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.size("hashes") - (RUN - 1), F.lit(0))))
    rows = rows.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            # sorted windows with their places, only where some window comes twice
            "windows": F.when(
                F.size(F.array_distinct("hashes")) < F.size("hashes"),
                F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    ).drop("lines", "hashes")
    near = lambda k: F.get("windows", k)["h"]
    rows = rows.withColumn(
        "places",
        F.when(
            F.col("windows").isNotNull(),
            F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            "windows",
                            lambda w, k: F.struct(
                                w["i"].alias("i"),
                                (F.coalesce(near(k - 1) == w["h"], F.lit(False)) | F.coalesce(near(k + 1) == w["h"], F.lit(False))).alias("twice"),
                            ),
                        ),
                        lambda w: w["twice"],
                    ),
                    lambda w: w["i"],
                )
            ),
        ),
    ).drop("windows")
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(RUN), F.coalesce(F.get("places", k + 1) - p, F.lit(RUN)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def _with_next(step: int):
    return lambda h, i: F.xxhash64(h, F.get("hashes", i + step))


def vectors(rows: DataFrame) -> DataFrame:
    """The transformed statistics: logarithm of the mean word length, square roots of shares."""
    share = lambda part, whole: F.sqrt(F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumns(
        {
            "base_failed": failed,
            "v_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "v_symbols": F.least(share("n_symbols", "n_words"), F.lit(1.0)),
            "v_lines": share("n_dup_lines", "n_lines"),
            "v_repeats": share("n_repeat_words", "n_words"),
            "v_capitals": share("n_capitals", "word_chars"),
            "v_twins": share("n_twins", "n_words"),
        }
    )


def _key(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """Adds `grp`, whose estimate judges the row, and `labels`, the groups whose estimates the row enters.

    `grp` is language and source, or the language, or all, whichever has enough rows.
    """
    fit = F.count(F.when(~F.col("base_failed"), 1))
    fine = rows.groupBy(_key("lang", "source").alias("own"), _key("lang").alias("wide")).agg(fit.alias("n"))
    wide = fine.groupBy("wide").agg(F.sum("n").alias("all"))
    pick = fine.join(wide, "wide").select(
        "own",
        "wide",
        F.when(F.col("n") >= least_rows, F.col("own")).when(F.col("all") >= least_rows, F.col("wide")).otherwise("all").alias("grp"),
    )
    pick = written(pick, "pick")
    entered = pick.select("own", F.explode(F.array("own", "wide", F.lit("all"))).alias("label"))
    entered = entered.join(pick.select(F.col("grp").alias("label")).distinct(), "label", "left_semi")
    entered = entered.groupBy("own").agg(F.collect_set("label").alias("labels"))
    pick = pick.join(entered, "own", "left").select("own", "grp", "labels")
    return rows.withColumn("own", _key("lang", "source")).join(pick, "own").drop("own")


def _moments() -> list[Column]:
    sums = ["count(*) as n"] + [f"sum({a}) as s_{a}" for a in AXES]
    sums += [f"sum({a} * {b}) as s_{a}_{b}" for i, a in enumerate(AXES) for b in AXES[: i + 1]]
    return [F.expr(s) for s in sums]


def _estimate(sums: DataFrame, *keys: str) -> DataFrame:
    """Means `m_i`, the inverse factor `l_i_j` of the scatter, and its log determinant, from sums."""
    p = len(AXES)
    total = lambda terms: " + ".join(["0D", *terms])
    # as SQL text: hundreds of small expressions cost the driver seconds when built one call at a time
    cov = {
        (i, j): f"s_{AXES[i]}_{AXES[j]} / n - s_{AXES[i]} / n * s_{AXES[j]} / n" for i in range(p) for j in range(i + 1)
    }
    out = sums.selectExpr(
        *keys,
        *[f"s_{a} / n as m_{i}" for i, a in enumerate(AXES)],
        *[
            f"greatest({c}, 0D) + {FLOORS[i] ** 2}D as c_{i}_{j}" if i == j else f"{c} as c_{i}_{j}"
            for (i, j), c in cov.items()
        ],
    )
    for j in range(p):  # Cholesky factor, column by column; the floors keep it positive
        rest = f"c_{j}_{j} - ({total(f'g_{j}_{k} * g_{j}_{k}' for k in range(j))})"
        out = out.selectExpr("*", f"sqrt(greatest({rest}, {FLOORS[j] ** 2 / 4}D)) as g_{j}_{j}")
        below = [
            f"(c_{i}_{j} - ({total(f'g_{i}_{k} * g_{j}_{k}' for k in range(j))})) / g_{j}_{j} as g_{i}_{j}"
            for i in range(j + 1, p)
        ]
        out = out.selectExpr("*", *below)
    out = out.selectExpr("*", *[f"1 / g_{j}_{j} as l_{j}_{j}" for j in range(p)])
    for off in range(1, p):  # its inverse, one diagonal after the other
        out = out.selectExpr(
            "*",
            *[
                f"-({total(f'g_{j + off}_{k} * l_{k}_{j}' for k in range(j, j + off))}) / g_{j + off}_{j + off} as l_{j + off}_{j}"
                for j in range(p - off)
            ],
        )
    return out.selectExpr(
        *keys,
        *[f"m_{i}" for i in range(p)],
        *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)],
        f"2 * ({total(f'ln(g_{j}_{j})' for j in range(p))}) as logdet",
    )


def _settled(sums: DataFrame, *keys: str) -> DataFrame:
    """Estimates of written sums: the factors are many columns, planned apart from the scan of the rows."""
    small = written(sums, "sums")
    params = written(_estimate(small, *keys), "mcd")
    discard(small)
    return params


def _distance() -> Column:
    parts = [" + ".join(f"l_{i}_{j} * ({AXES[j]} - m_{j})" for j in range(i + 1)) for i in range(len(AXES))]
    return F.expr(" + ".join(f"power({part}, 2)" for part in parts))


def _bin(d: Column) -> Column:
    return F.floor(16 * F.log2(d + 1e-6)).cast("int")


def _nearest(rows: DataFrame, params: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Sums over the `share` of rows nearest to each estimate, and the bin where the share ends."""
    from pyspark.sql import Window

    by_bin = rows.join(params, "grp").withColumn("bin", _bin(_distance())).groupBy(*keys, "bin").agg(*_moments())
    order = Window.partitionBy(*keys).orderBy("bin")
    total = F.sum("n").over(Window.partitionBy(*keys))
    kept = by_bin.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("total", total)
    kept = kept.where(F.col("before") < F.lit(share) * F.col("total"))
    names = [c for c in by_bin.columns if c == "n" or c.startswith("s_")]
    return kept.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], F.max("bin").alias("edge"))


def _starts(rows: DataFrame) -> DataFrame:
    """Sums of the starts. Start 0: all rows; start 1: medians with floor scales; others: a few rows drawn by hash."""
    p = len(AXES)
    all_rows = rows.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(0))
    mid = rows.groupBy("grp").agg(*[F.percentile_approx(a, 0.5, 1000).alias(a) for a in AXES])
    single = [F.lit(1).alias("n")] + [F.col(a).alias(f"s_{a}") for a in AXES]
    single += [(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(AXES) for b in AXES[: i + 1]]
    middle = mid.select("grp", *single, F.lit(1).alias("start"))
    drawn = None
    for start in range(2, STARTS):
        picks = [F.min_by(F.struct(*AXES), F.xxhash64(F.lit(start * 100 + k), *AXES)).alias(f"p{k}") for k in range(p + 1)]
        few = rows.groupBy("grp").agg(*picks).select("grp", F.explode(F.array(*[f"p{k}" for k in range(p + 1)])).alias("v"))
        few = few.select("grp", "v.*").groupBy("grp").agg(*_moments()).withColumn("start", F.lit(start))
        drawn = few if drawn is None else drawn.unionByName(few)
    return all_rows.unionByName(middle).unionByName(drawn)


def estimates(rows: DataFrame) -> DataFrame:
    """Location and scaled scatter factor of every group `grp`, from rows that pass the base rule."""
    from pyspark.sql import Window

    params = _settled(_starts(rows), "grp", "start")
    for _ in range(STEPS):
        after = _settled(_nearest(rows, params, ["grp", "start"], SUBSET), "grp", "start")
        discard(params)
        params = after
    first = Window.partitionBy("grp").orderBy("logdet", "start")
    best = params.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "start")
    # the median distance of a clean normal group tells the scale; then rows within the weight bound decide
    middle = _nearest(rows, best, ["grp"], 0.5).select("grp", (F.pow(F.lit(2.0), (F.col("edge") + 1) / 16) / CHI_MEDIAN).alias("scale"))
    scaled = best.join(middle, "grp").withColumn("scale", F.greatest("scale", F.lit(1.0)))
    weighed = rows.join(scaled, "grp").where(_distance() <= F.col("scale") * CHI_WEIGHT).groupBy("grp").agg(*_moments())
    return _settled(weighed, "grp")


def quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """Counts, base verdict and the verdict of the robust distance for every document.

    Returns `doc_id`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`,
    `base_failed`, `distance` (squared) and `kept`.
    """
    named = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    stats = written(vectors(counts(named, "doc_id", "text", "lang", "source")), "stats")
    grouped = written(_grouped(stats, least_rows), "grouped")
    discard(stats)
    params = estimates(grouped.where("not base_failed").select(F.explode("labels").alias("grp"), *AXES))
    judged = grouped.join(params, "grp", "left").withColumn("distance", _distance())
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


__all__ = ["counts", "estimates", "quality", "vectors"]
