"""Repeated passages by difference-cover anchors.

A passage of `window` words that occurs twice is found through anchors: shorter windows hashed only
at places whose position modulo `PERIOD` lies in a difference cover. For any two places there is a
shift below the period that brings both onto the cover, so two equal passages share an anchor at
the same shift. Anchors found twice are extended: of every window around one, the hash of all its
words is compared, and windows found twice are removed. A sixth of the places is hashed and sent in
the first pass, and in the second only the surroundings of repeats.

Both passes settle repeats inside a batch on the spot, so a passage that fills a third of all rows
sends one row per batch. Texts stay in their cells; only hashes and places are shuffled. Windows
are compared by two hashes of 64 and 32 bits.

Edge cases: null and empty texts have no words; texts shorter than a window keep all; repeated rows
repeat each other's windows and lose them all; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .cells import celled, found_twice, meet, slices
from .common import release, written

#: Words of a passage.
WINDOW = 35
#: Every difference modulo 21 is one of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Characters of text a task hashes at once.
SLICE = 6_000_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACES = "known boolean, key long, check int, cell long, row long, pos int"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of `length` values, from running sums of a polynomial modulo 2**64."""
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))
    inverse = np.cumprod(
        np.concatenate((np.ones(1, np.uint64), np.full(n - length, pow(base, -1, 2**64), np.uint64)))
    )
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers)))
    x = (sums[length:] - sums[: n - length + 1]) * inverse
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def places(keys: np.ndarray, checks: np.ndarray, cell: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows for `found_twice`; repeats within the batch are settled here."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(first) - 1
    known = np.bincount(group)[group] > 1 if len(k) else np.zeros(0, bool)
    row, pos, cell = row[order], pos[order], cell[order]
    own = (row.astype(np.uint64) * np.uint64(_BASES[0])) ^ (pos.astype(np.uint64) * np.uint64(_BASES[1]))
    k = np.where(first, k, own)
    c = np.where(first, c, np.int32(-1))
    arrays = [known, k.view(np.int64), c, cell, row, pos.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["known", "key", "check", "cell", "row", "pos"])


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, the text of each word and its place in the text."""
    words = [t.encode().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    values = np.concatenate([word_hashes(w) for w in words]) if len(owner) else np.zeros(0, np.uint64)
    return values, owner, pos


def _anchors(window: int):
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                values, owner, pos = _flat(batch.column(2).to_pylist())
                keys = window_hashes(values, length)
                last = len(keys)
                use = (owner[:last] == owner[len(owner) - last :]) & member[pos[:last] % PERIOD]
                cell, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                at = owner[:last][use]
                yield places(keys[use], np.zeros(len(at), np.int32), cell[at], row[at], pos[:last][use])

    return run


def _windows(window: int):
    reach = PERIOD - 1  # an anchor inside a window begins at most so many words behind the window

    def one(texts: pa.Table, found: pa.Table) -> pa.Table:
        empty = places(*[np.zeros(0, t) for t in (np.uint64, np.int32, np.int64, np.int64, np.int64)])
        if not texts.num_rows or not found.num_rows:
            return pa.Table.from_batches([empty])
        hot = set(found.column("row").to_pylist())
        texts = texts.filter(pa.array([r in hot for r in texts.column("row").to_pylist()]))
        out = []
        rows = {r: k for k, r in enumerate(texts.column("row").to_pylist())}
        at = np.array([rows[r] for r in found.column("row").to_pylist()], np.int64)
        start = found.column("pos").to_numpy().astype(np.int64)
        values, owner, pos = _flat(texts.column("text").to_pylist())
        begin = np.searchsorted(owner, np.arange(texts.num_rows))
        flag = np.zeros(len(owner) + reach + 1, np.int64)
        flag[begin[at] + start] = 1
        seen = np.concatenate(([0], np.cumsum(flag)))
        keys = window_hashes(values, window)
        last = len(keys)
        index = np.arange(last)
        use = (seen[index + reach + 1] - seen[index] > 0) & (owner[:last] == owner[len(owner) - last :])
        checks = (window_hashes(values, window, 1)[use] & np.uint64(0x7FFFFFFF)).astype(np.int32)
        mine = owner[:last][use]
        cell, row = texts.column("cell").to_numpy(), texts.column("row").to_numpy()
        out.append(places(keys[use], checks, cell[mine], row[mine], pos[:last][use]))
        return pa.Table.from_batches(out)

    return one


def _kept(window: int, kind: pa.DataType):
    def one(texts: pa.Table, found: pa.Table) -> pa.Table:
        starts: dict[int, list[int]] = {}
        for r, p in zip(found.column("row").to_pylist(), found.column("pos").to_pylist()):
            starts.setdefault(r, []).append(p)
        out = []
        for r, text in zip(texts.column("row").to_pylist(), texts.column("text").to_pylist()):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if r in starts:
                begin = np.array(starts[r])
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
            out.append((len(words), int((~keep).sum()), kept.decode()))
        n, removed, kept_texts = zip(*out) if out else ((), (), ())
        return pa.table(
            {
                "doc_id": texts.column("doc_id").cast(kind),
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept_texts], pa.string()),
                "kept_text": pa.array(kept_texts, pa.string()),
            }
        )

    return one


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document without the words of passages that occur twice anywhere.

    Returns `doc_id`, `n_words`, `n_removed`, `kept_sha256` and `kept_text` (kept words by one blank).
    """
    if window <= PERIOD:
        raise ValueError(f"a passage needs more than {PERIOD} words")
    from pyspark.sql.pandas.types import to_arrow_type

    cells = celled(df, id_col, text_col)
    anchors = cells.select("cell", "row", "text").mapInArrow(_anchors(window), PLACES)
    anchors = written(found_twice(anchors), "anchors")
    release(df.sparkSession)
    windows = written(found_twice(meet(cells.select("cell", "row", "text"), anchors, _windows(window), PLACES)), "windows")
    release(df.sparkSession)
    field = cells.schema["doc_id"].dataType
    shape = f"doc_id {field.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return meet(cells, windows, _kept(window, to_arrow_type(field)), shape)
