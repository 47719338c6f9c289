"""Language of a text: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's lower-case words give their character n-grams with marks at both word ends, `GRAMS` long; each
is hashed to one of `BUCKETS` rows of an embedding table. The mean of a text's rows meets one weight
vector per language, and a softmax gives probabilities. Table and weights are trained together by
stochastic gradient descent in numpy. Four fifths of the sampled rows train; the others set the
temperature of the softmax (least log loss) and the score from which a prediction is accepted: the
least one whose accepted rows are right in a share of `PRECISION`.

Training looks at about `SAMPLE_ROWS` rows with a language at most, shared evenly among the languages,
those with the least hash of their id, whole texts of each; the sample trains in one task. Rows with
crc32(id) mod 4 = 2 are held out from everything that is learnt. Language, source and id are no inputs
of a prediction.

Edge cases: a text that is null or has no letter is `und` with score 0 and is not accepted; without a
row to learn from every text is; with one language every other text is that language with score 1;
equal scores go to the language first by code point; repeated rows are predicted alike; texts of any
length are read whole, a slice at a time; an empty table gives an empty result; other columns are not
read, and a language column that is null or missing from a row only takes it out of training.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import slices
from .common import written

#: Rows of the embedding table as a power of two, its columns, and the lengths of n-grams.
BUCKET_BITS, DIMENSIONS, GRAMS = 15, 16, (2, 3)
#: Most rows, about, that training looks at.
SAMPLE_ROWS = 8_000
#: Passes over the sample, first step width, and every how many-th row calibrates.
EPOCHS, STEP, CALIBRATES = 4, 0.5, 5
#: Share of right predictions among the accepted ones of the calibration rows.
PRECISION = 0.99
#: Code points hashed at once, characters of a batch's slice.
SLICE = 1_000_000
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text's words, in slices that end between words where they can."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = 0
    while begin < len(points):
        end = min(begin + SLICE, len(points))
        if end < len(points):
            gaps = np.flatnonzero(~letters()[points[begin:end]])
            end = begin + int(gaps[-1]) + 1 if len(gaps) else end
        part = points[begin:end]
        begin = end
        inside = letters()[part]
        # every gap becomes one mark, so that neighbouring words share it as end and as begin
        marked = np.where(inside, part, 0)
        first = np.ones(len(part), bool)
        first[1:] = inside[1:] | inside[:-1]
        marked = np.concatenate(([0], marked[first], [0])).astype(np.uint64)
        letter = marked > 0
        found = []
        for n in GRAMS:
            last = len(marked) - n + 1
            if last <= 0:
                continue
            code = np.full(last, np.uint64(n))
            whole = np.ones(last, bool)
            for k in range(n):
                code = (code ^ marked[k : k + last]) * _MIX
                code ^= code >> np.uint64(29)
                if 0 < k < n - 1:
                    whole &= letter[k : k + last]  # marks only at the ends
            if n == 2:
                whole &= letter[:last] | letter[1:]
            found.append((code[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        if found:
            yield np.concatenate(found)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and the share of each in its n-grams."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for part in buckets(text):
        total += np.bincount(part, minlength=len(total))
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(-1, keepdims=True))
    return grown / grown.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each bucket and the constant: embeddings times weights, by stochastic gradient descent."""
    chance = np.random.default_rng(13)
    table = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32)
    weights = chance.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, classes)).astype(np.float32)
    constant = np.zeros(classes, np.float32)
    steps = EPOCHS * len(rows)
    done = 0
    for _ in range(EPOCHS):
        for k in chance.permutation(len(rows)):
            at, share = rows[k]
            rate = np.float32(STEP * (1 - done / steps))
            done += 1
            mean = share @ table[at]
            slope = softmax(mean @ weights + constant)
            slope[target[k]] -= 1
            back = weights @ slope
            weights -= rate * np.outer(mean, slope)
            constant -= rate * np.float32(0.1) * slope
            # the step of a bucket goes with its share, scaled so that the mean itself moves by `rate`
            table[at] -= np.outer(share * (rate / (share @ share)), back)
    return table @ weights, constant


def calibrate(logits: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the least score whose accepted rows reach `PRECISION`."""
    if not len(target):
        return 1.0, 0.0
    choices = np.exp(np.linspace(-3, 3, 61))
    # targets keep the chance of an error not yet seen, so that a faultless sample does not claim certainty
    doubt = 1 / (len(target) + 2)
    goal = np.full(logits.shape, doubt / logits.shape[1])
    goal[np.arange(len(target)), target] += 1 - doubt
    losses = [-(goal * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in choices]
    heat = float(choices[int(np.argmin(losses))])
    chances = softmax(logits / heat)
    score, right = chances.max(1), chances.argmax(1) == target
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= PRECISION)
    return heat, float(score[order][good[-1]]) if len(good) else 1.0


def fit(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, logits of the buckets, constant (both over the temperature) and accepted score.

    `sample` has `text`, `lang`, `calibrates`, a bounded number of rows; one task trains.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, holds = [], [], []
        for batch in batches:
            for text, lang, hold in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows.append(counted(text))
                names.append(lang)
                holds.append(hold)
        langs = sorted(set(names))
        if not langs:
            return
        target = np.array([langs.index(n) for n in names])
        hold = np.array(holds, bool)
        learn = np.flatnonzero(~hold)
        learn = learn if len(set(target[learn])) == len(langs) else np.arange(len(rows))
        table, constant = train([rows[k] for k in learn], target[learn], len(langs))
        judged = np.flatnonzero(hold)
        logits = np.array([rows[k][1] @ table[rows[k][0]] + constant for k in judged]).reshape(-1, len(langs))
        heat, accepted = calibrate(logits, target[judged])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs], pa.list_(pa.string())),
                pa.array([(table / heat).astype(np.float32).tobytes()], pa.binary()),
                pa.array([(constant / heat).astype(np.float32).tobytes()], pa.binary()),
                pa.array([accepted], pa.float64()),
            ],
            ["langs", "logits", "constant", "accepted"],
        )

    schema = "langs array<string>, logits binary, constant binary, accepted double"
    # ordered, so that the steps of the descent do not depend on the layout of the files
    one = sample.repartition(1).sortWithinPartitions("rank", "text", "lang").select("text", "lang", "calibrates")
    got = one.mapInArrow(run, schema).first()
    if got is None:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0
    table = np.frombuffer(bytes(got.logits), np.float32).reshape(1 << BUCKET_BITS, len(got.langs))
    return list(got.langs), table, np.frombuffer(bytes(got.constant), np.float32), got.accepted


def chances(text: str, table: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Probability of each language for one text."""
    total, n = np.zeros(len(constant)), 0
    for part in buckets(text):
        total += np.bincount(part, minlength=len(table)) @ table if len(part) > len(table) else table[part].sum(0, dtype=float)
        n += len(part)
    return softmax(total / max(1, n) + constant)


def sampled(rows: DataFrame) -> DataFrame:
    """The training rows: of each language those whose hash lies under its share of `SAMPLE_ROWS`.

    `rows` has `doc_id, text, lang`. Languages share the sample evenly; only their counts reach the driver.
    """
    usable = rows.where("lang is not null and text is not null").where(~held_out("doc_id")).where(F.col("text").rlike(r"\p{L}"))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS)
    counts = {r["lang"]: r["count"] for r in sizes.collect()}
    each = SAMPLE_ROWS / max(1, len(counts))
    hashed = usable.withColumn("rank", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40)))
    limits = rows.sparkSession.createDataFrame(
        [(lang, int(min(1.0, each / n) * (1 << 40))) for lang, n in counts.items()], "lang string, below long"
    )
    picked = hashed.join(F.broadcast(limits), "lang").where("rank < below")
    return picked.select("text", "lang", "rank", (F.pmod("rank", F.lit(CALIBRATES)) == 0).alias("calibrates"))


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` and `accepted` of every document."""
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    langs, table, constant, accepted = fit(written(sampled(rows), "languages"))
    names = ["doc_id", "held_out", "lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                found, scores = [], []
                for text in batch.column(2).to_pylist():
                    if text is None or not langs or not any(map(str.isalpha, text)):
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    p = chances(text, table, constant)
                    found.append(langs[int(p.argmax())])
                    scores.append(float(p.max()))
                taken = [f != UNKNOWN and s >= accepted for f, s in zip(found, scores)]
                columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(taken, pa.bool_())], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return marked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
