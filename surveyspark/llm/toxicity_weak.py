"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are word stems and patterns. Stems come from a short seed list and from labelled rows of the
training fold, by how much more often they start words of toxic documents; patterns look at shouting,
runs of exclamation marks and direct address. A generative model (class share, and for each voter the
rate of firing in either class) is fitted by expectation maximisation; correlations of voters within
a class are estimated with it and discount voters that repeat each other. A linear classifier is then
trained on the posterior labels and scores every whole text.

Fitting uses at most `SAMPLE_ROWS` labelled rows of the training fold, those with the least hash of
their id; rows with crc32(id) mod 3 = 1 are held out from everything that is learnt. Labels, language,
source and id are no inputs of a score.

Edge cases: null and empty texts are scored by the classifier's constant; without labelled rows of
both classes the seed stems alone vote; repeated rows score alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

#: Most labelled rows a fit looks at.
SAMPLE_ROWS = 20_000
#: Most stems that vote, their share of toxic rows, and minus the logarithm of the chance of that share.
STEMS, PURITY, SURPRISE = 300, 0.9, 12.0
#: Lengths of stems.
STEM_CHARS = (4, 5, 6, 7)
#: Seed stems, fixed values.
SEEDS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
ROUNDS = 6
#: Log odds of a label, and rows by which the rates of voters are drawn to their mean.
LABEL_ODDS, PRIOR_ROWS = 2.0, 2.0
#: Correlation inside the toxic class from which voters are taken to repeat each other.
CORRELATED = 0.3

_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
_BANGS = re.compile(r"!{2,}")
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|vous|toi|usted|eres)\b", re.IGNORECASE)
PATTERNS = 3


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def plain(text: str) -> str:
    """Lower case, words parted by one blank, as one character per byte for the automaton."""
    raw = re.sub(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", b" ", text.lower().encode())
    return f" {raw.decode('latin-1')} "


def voters(stems: list[str]) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for k, stem in enumerate(stems):
        machine.add_word(" " + stem.encode().decode("latin-1"), k)
    if not stems:
        return None
    machine.make_automaton()
    return machine


def features(text: str | None, machine, n_stems: int) -> np.ndarray:
    """Votes of stems and patterns, then the share of hit words and the logarithm of hits."""
    out = np.zeros(n_stems + PATTERNS + 2)
    text = text or ""
    if machine is not None:
        flat = plain(text)
        ends = set()
        for stop, k in machine.iter(flat):
            out[k] = 1
            ends.add(flat.rfind(" ", 0, stop))
        words = max(1, flat.count(" ") - 1)
        out[-2], out[-1] = min(1.0, 10 * len(ends) / words), np.log1p(len(ends))
    words = max(1, text.count(" ") + 1)
    out[n_stems] = len(_SHOUT.findall(text)) > 0.3 * words
    out[n_stems + 1] = len(_BANGS.findall(text)) > 0.1 * words
    out[n_stems + 2] = len(_ADDRESS.findall(text)) > 0.02 * words
    return out


def learnt_stems(rows: DataFrame) -> list[str]:
    """Word beginnings that mark toxic rows of `(text, toxic)`, the best first, none inside another."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1))
    stems = F.array_distinct(
        F.flatten(F.transform(words, lambda w: F.array(*[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in STEM_CHARS])))
    )
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < share < 1:
        return []
    seen = rows.select("toxic", F.explode(stems).alias("stem")).where("stem is not null")
    ones = F.count(F.when(F.col("toxic") == 1, 1))
    counted = seen.groupBy("stem").agg(ones.alias("ones"), F.count("*").alias("n"))
    least = SURPRISE / -np.log(share)
    strong = counted.where((F.col("ones") >= float(least)) & (F.col("ones") >= PURITY * F.col("n")))
    found = [r.stem for r in strong.orderBy(F.desc("ones"), F.length("stem"), "stem").limit(STEMS).collect()]
    return [s for s in found if not any(s != t and s.startswith(t) for t in found)]


def label_model(votes: np.ndarray, silent: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Posterior probability of the toxic class of each row.

    A voter that does not fire abstains; `silent` says that no stem fired, a vote for the clean class.
    The label is one more voter, of the given reliability `LABEL_ODDS`.
    """
    post = labels.astype(float)
    votes = np.hstack((votes, silent[:, None])).astype(float)
    for _ in range(ROUNDS):
        share = np.clip(post.mean(), 0.01, 0.5)
        weight = np.stack((1 - post, post))
        mean = (votes.sum(0) + 1) / (len(votes) + 2)
        rate = (weight @ votes + PRIOR_ROWS * mean) / (weight.sum(1, keepdims=True) + PRIOR_ROWS)
        # correlation inside the toxic class: voters that fire together count for one
        dev = (votes - rate[1]) * np.sqrt(post)[:, None]
        cov = dev.T @ dev / max(1.0, post.sum())
        sd = np.sqrt(np.diag(cov)) + 1e-3
        joint = cov / np.outer(sd, sd)
        np.fill_diagonal(joint, 0)
        trust = 1 / (1 + np.where(joint > CORRELATED, joint, 0).sum(1))
        odds = np.log(share / (1 - share)) + votes @ (trust * np.log(rate[1] / rate[0]))
        odds += np.where(labels > 0, LABEL_ODDS, -LABEL_ODDS)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def linear_fit(x: np.ndarray, target: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights and constant of a logistic regression on probabilities, by Newton steps."""
    full = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(full.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - target) + ridge * w
        bend = (full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Stems and weights from labelled rows `(text, toxic)`, a bounded number."""
    learnt = learnt_stems(rows)
    stems = [s for s in SEEDS if not any(s.startswith(t) for t in learnt)] + learnt
    n_stems = len(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = voters(stems)
        for batch in batches:
            found = [features(t, machine, n_stems).astype(np.float32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["x", "toxic"])

    got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "x binary, toxic int").collect()
    toxic = np.array([r.toxic for r in got], float)
    if not len(got) or toxic.min() == toxic.max():
        weights = np.zeros(n_stems + PATTERNS + 3)
        weights[:n_stems], weights[-1] = 4.0, -3.0
        return stems, weights
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    votes = x[:, : n_stems + PATTERNS]
    silent = votes[:, :n_stems].sum(1) == 0
    return stems, linear_fit(x, label_model(votes, silent, toxic))


def scores(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` of every document."""
    rows = id_and_text(documents, id_col, text_col)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("toxic is not null").distinct()
    chosen = marks.where(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE_ROWS)
    sample = written(rows.join(chosen, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), "sample")
    stems, weights = fit(sample)
    n_stems = len(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = voters(stems)
        for batch in batches:
            values = []
            for text in batch.column(2):
                odds = float(features(text.as_py(), machine, n_stems) @ weights[:-1] + weights[-1])
                values.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            columns = [batch.column(0), batch.column(1), pa.array(values, pa.float64())]
            columns.append(pa.array([int(v >= THRESHOLD) for v in values], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return marked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
