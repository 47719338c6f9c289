"""Benchmark decontamination with an Aho-Corasick automaton.

All windows of consecutive words of the benchmark items go into one automaton over normalised text,
and every document is scanned once. Texts and items are normalised alike: A to Z become lower case,
all other ASCII characters but digits and a to z part words, and words are joined by one blank. The
automaton runs on bytes, so every other character is kept as it is. Ends of hits lead to words by
the word ends, and words lead back to places in the original text by a second cut of texts with hits.

The windows travel to the tasks as a broadcast whose size is counted first: items are dealt into
blocks of at most `block_bytes` of window text, one automaton and one scan per block, and hits of
blocks are put together per document. The usual benchmark fits one block.

Edge cases: null and empty texts have no words; an item without words has no window, one with fewer
words than a window is a window; repeated rows are scanned each on its own; an item listed twice
counts once; a null item id has no name and its words still count as hits; empty tables give an
empty or a clean result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

#: Words of a window.
WINDOW = 10
#: Window text of one automaton, in bytes; about forty times that is held in memory by a task.
BLOCK_BYTES = 4_000_000

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: The words of an original text, for spans.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    # blanks and controls 28 to 31 part words too: the fold has made them blanks already
    return (text or "").encode().translate(_FOLD).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[bytes]:
    """The windows of an item; all its words if they are fewer."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))}


def automaton(windows: dict[bytes, list]) -> ahocorasick.Automaton | None:
    """Finds ` window ` in blank-padded normalised text, with word count and item ids."""
    if not windows:
        return None
    machine = ahocorasick.Automaton()
    for text, items in windows.items():
        machine.add_word(f" {text.decode('latin-1')} ", (text.count(b" ") + 1, items))
    machine.make_automaton()
    return machine


def scan(machine: ahocorasick.Automaton | None, text: str | None) -> tuple[int, np.ndarray, set]:
    """Word count, hit flag of each word, and ids of the items with a window in the text."""
    words = words_of(text)
    hit = np.zeros(len(words), bool)
    items: set = set()
    if machine is None or not words:
        return len(words), hit, items
    flat = f" {b' '.join(words).decode('latin-1')} "
    ends = None
    for stop, (count, ids) in machine.iter(flat):
        if ends is None:  # place of the blank behind each word
            ends = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(ends, stop))
        hit[last - count + 1 : last + 1] = True
        items.update(ids)
    return len(words), hit, items


def spans_of(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """Places (from, to) in code points of runs of hit words in the original text."""
    raw = (text or "").encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [
        (len(raw[: places[i][0]].decode()), len(raw[: places[j - 1][1]].decode()))
        for i, j in zip(edge[::2], edge[1::2])
    ]


def _blocks(benchmark: DataFrame, block_bytes: int, window: int) -> tuple[DataFrame, int]:
    """Items with the block they belong to, by running size of their windows' text."""
    sized = benchmark.withColumn("size", (F.length("text") + 1) * window)
    total = sized.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    return sized.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks))), blocks


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hits of benchmark windows in every document.

    Returns `doc_id`, `n_words`, `n_hit`, `items` (sorted texts of item ids) and `spans` (places of
    runs of hit words in the original text, from and behind, in code points).
    """
    rows = id_and_text(documents, id_col, text_col)
    listed = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    dealt, blocks = _blocks(listed, block_bytes, window)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"
    if blocks == 1:
        return rows.mapInArrow(_scanner(_windows(dealt, window), "spans"), shape)
    # hits of several blocks overlap: gather hit words per document by a key of the row
    keyed = written(rows.withColumn("row_no", F.monotonically_increasing_id()), "texts")
    parts = None
    for block in range(blocks):
        part = keyed.select("row_no", "text").mapInArrow(
            _scanner(_windows(dealt.where(F.col("block") == block), window), "words"),
            "row_no long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>",
        )
        part = written(part.where("n_hit > 0"), "hits")
        parts = part if parts is None else parts.unionByName(part)
    hits = parts.groupBy("row_no").agg(
        F.flatten(F.collect_list("spans")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return keyed.join(hits, "row_no", "left").select("doc_id", "text", "runs", "items").mapInArrow(_merger, shape)


def without_benchmark(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `df`, all columns, whose text holds no window of the benchmark; one pass per block."""
    listed = benchmark.select(F.lit("").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    dealt, blocks = _blocks(listed.where("text is not null"), block_bytes, window)
    at = df.columns.index(text_col)
    for block in range(blocks):
        windows = _windows(dealt.where(F.col("block") == block), window)
        shared = SparkContext._active_spark_context.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                clean = [not scan(machine, t.as_py())[1].any() for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def _windows(items: DataFrame, window: int) -> dict[bytes, list]:
    """Window texts of one block with their items; the block's size is bounded before it is gathered."""
    found: dict[bytes, set] = {}
    for item, text in items.select("item", "text").toLocalIterator():
        for w in item_windows(text, window):
            found.setdefault(w, set()).add(item)
    return {w: sorted(i for i in ids if i is not None) for w, ids in found.items()}


def _scanner(windows: dict[bytes, list], spans_as: str):
    shared = SparkContext._active_spark_context.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            key, out = batch.column(0), []
            for value in batch.column(1):
                text = value.as_py()
                n, hit, items = scan(machine, text)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                places = spans_of(text, hit) if runs and spans_as == "spans" else runs
                out.append((n, int(hit.sum()), sorted(items), [{"start": i, "stop": j} for i, j in places]))
            yield _result(key, out, batch.schema.names[0])

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            hit = np.zeros(len(words_of(text)), bool)
            for r in runs or []:
                hit[r["start"] : r["stop"]] = True
            places = spans_of(text, hit) if runs else []
            out.append((len(hit), int(hit.sum()), items or [], [{"start": i, "stop": j} for i, j in places]))
        yield _result(batch.column(0), out, "doc_id")


def _result(key: pa.Array, rows: list[tuple], name: str) -> pa.RecordBatch:
    place = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), place]
    columns = list(zip(*rows)) if rows else [()] * 4
    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([key, *arrays], [name, "n_words", "n_hit", "items", "spans"])


def digest(items: list[str]) -> str:
    """The item digest of the query, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
