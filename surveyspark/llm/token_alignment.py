"""Alignment of two tokenizers over the same bytes, and how usual each link is in the corpus.

Every text is encoded twice: a blank and the text by a byte-level BPE (A), the text by a piece model that
adds the blank itself (B). Places where tokens of both end cut the tokens into groups. They are found by
divide and conquer: in each interval between known cuts a common end near the middle is located, by
bisecting the ends of B for ends of A at growing distance from the middle; both halves go on, and an
interval without a common end becomes a leaf group. All intervals of a slice of texts take each step
together, in numpy.

A link is a pair of token occurrences that end together. Links are counted over the whole corpus: tasks
lay neighbouring texts into cells of at most `CELL_LINKS` links (a larger text is a cell of its own) and
sum up equal pairs of a cell, so a pair occurs at most once per cell in the shuffle; counts come back to
their cell, never to single links. The best count of each id of B is broadcast; its size is bounded by
the vocabulary of the piece model.

Long texts are encoded in parts that begin with a blank after another character; neither tokenizer joins
tokens across such a place (the piece model is checked for it), so ids are those of the whole text. The
byte-level vocabulary is applied by its ranks where its file proves that ranks and merges agree.

Edge cases: a text that is null, empty, or not given back by the bytes of either side's tokens has no
tokens, zeros and an empty digest; repeated rows count each on their own; equal counts of an id of B are
all best; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import slices
from .common import id_and_text, written

#: Links of a cell of neighbouring texts.
CELL_LINKS = 4_000_000
#: Characters of texts encoded and aligned together, and of one part of a long text.
SLICE = 1_000_000
#: Room for ids of B in the number of a pair.
PAIR_BASE = 1 << 20
BLANK_MARK = "▁"

_PART = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, json_path: str, model_path: str):
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        of_char = byte_alphabet()
        with open(json_path, encoding="utf-8") as lines:
            stored = json.load(lines)
        added = {t["id"] for t in stored["added_tokens"]}
        names = {k: n for n, k in stored["model"]["vocab"].items()} | {t["id"]: t["content"] for t in stored["added_tokens"]}
        size = max(names) + 1
        self.bytes_a = [
            names.get(k, "").encode() if k in added else bytes(map(of_char.__getitem__, names.get(k, ""))) for k in range(size)
        ]
        self.encode_a = byte_level(json_path, self.bytes_a, added)
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(BLANK_MARK, " ").encode())
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        inner = re.compile(f"[^{BLANK_MARK}]{BLANK_MARK}")
        self.parted = not any(inner.search(self.b.id_to_piece(k)) for k in range(len(self.bytes_b)))
        self.text_a = [[f"{k}{sign}" for k in range(size)] for sign in ",|"]
        self.text_b = [[f"{k}{sign}" for k in range(len(self.bytes_b))] for sign in (",", ";", "")]
        self.texts = [*self.text_a[0], *self.text_a[1], *self.text_b[0], *self.text_b[1], *self.text_b[2]]

    def parts(self, text: str) -> list[str]:
        """The text in parts of about `SLICE` characters, each cut before a blank that begins a word."""
        out, begin = [], 0
        while self.parted and len(text) - begin > SLICE:
            found = _PART.search(text, begin + SLICE)
            if found is None:
                break
            out.append(text[begin : found.start()])
            begin = found.end()
        return [*out, text[begin:]]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where their bytes are not those of a blank and the text."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return nothing
        a: list[np.ndarray] = []
        b: list[int] = []
        for part in self.parts(text):
            a.append(self.encode_a(" " + part))
            b += self.b.encode(part, num_threads=1)  # adds the blank itself
        whole = np.concatenate(a).astype(np.int64)
        raw = b" " + text.encode("utf-8", "replace")
        # a byte-level side that covers as many bytes covers these, so its bytes need no joining
        if self.size_a[whole].sum() != len(raw) or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return nothing
        return whole, np.array(b, np.int64)


def byte_level(json_path: str, of: list[bytes], added: set[int]):
    """The encoding function of a byte-level vocabulary.

    Where merges stand in the order of the ids they make, as training leaves them, ranks say the same
    as merges and the faster library for ranks is used; otherwise the vocabulary's own.
    """
    with open(json_path, encoding="utf-8") as lines:
        merges = json.load(lines)["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    of_char = byte_alphabet()
    made = [bytes(map(of_char.__getitem__, x + y)) for x, y in pairs]
    plain = [t for k, t in enumerate(of) if k not in added]
    if plain[256:] == made and sorted(plain[:256]) == [bytes([k]) for k in range(256)] and not added & set(range(len(plain))):
        ranks = {t: k for k, t in enumerate(plain)}
        ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: ranked.encode_to_numpy(text, disallowed_special=())
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)
    own.encode_special_tokens = True
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def pair(json_path: str, model_path: str) -> Pair:
    """The tokenizers of this Python worker."""
    return Pair(json_path, model_path)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of B that end together, in order, by divide and conquer.

    Ends rise along all texts; `last_a` and `last_b` are the last tokens of each text, which end together.
    """
    lo, hi = np.concatenate(([0], last_a[:-1] + 1)), last_a
    blo, bhi = np.concatenate(([0], last_b[:-1] + 1)), last_b
    cuts_a, cuts_b = [last_a], [last_b]
    while True:
        keep = (lo < hi) & (blo < bhi)  # an interval with one token on a side is a leaf
        lo, hi, blo, bhi = lo[keep], hi[keep], blo[keep], bhi[keep]
        if not len(lo):
            break
        middle = (lo + hi - 1) // 2
        met = np.searchsorted(ends_b, ends_a[middle])
        cut = np.where(ends_b[np.minimum(met, len(ends_b) - 1)] == ends_a[middle], middle, -1)
        open_, inner = np.flatnonzero((cut < 0) & (hi - lo > 1)), 1
        while len(open_):
            # places at a distance from `inner` to below twice that, on either side of the middle
            outer, at_middle = 2 * inner, middle[open_]
            left, right = np.maximum(lo[open_], at_middle - outer + 1), np.minimum(hi[open_], at_middle + outer)
            begins = np.concatenate((left, np.minimum(at_middle + inner, right)))
            sizes = np.concatenate((np.maximum(at_middle - inner + 1, left), right)) - begins
            sizes = np.maximum(sizes, 0)
            who = np.repeat(np.concatenate((open_, open_)), sizes)
            place = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
            at = np.searchsorted(ends_b, ends_a[place])
            shared = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[place]
            who, place, at = who[shared], place[shared], at[shared]
            if len(who):
                nearest = np.lexsort((place, np.abs(place - middle[who]), who))
                first = nearest[np.concatenate(([True], who[nearest][1:] != who[nearest][:-1]))]
                cut[who[first]], met[who[first]] = place[first], at[first]
            over = (at_middle - outer < lo[open_]) & (at_middle + outer >= hi[open_])
            open_, inner = open_[(cut[open_] < 0) & ~over], outer
        split = cut >= 0
        lo, hi, blo, bhi, cut, met = (v[split] for v in (lo, hi, blo, bhi, cut, met))
        cuts_a.append(cut)
        cuts_b.append(met)
        # halves stay side by side, so that the next ends are looked up in order
        lo, hi, blo, bhi = (
            np.stack(halves, 1).ravel() for halves in ((lo, cut + 1), (cut, hi), (blo, met + 1), (met, bhi))
        )
    found_a, found_b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(found_a)
    return found_a[order], found_b[order]


class Aligned:
    """Groups of a slice of encoded texts that have tokens."""

    def __init__(self, of: Pair, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n_a = np.array([len(a) for a, _ in rows])
        self.n_b = np.array([len(b) for _, b in rows])
        ids_a = np.concatenate([a for a, _ in rows])
        ids_b = np.concatenate([b for _, b in rows])
        last_a, last_b = np.cumsum(self.n_a) - 1, np.cumsum(self.n_b) - 1
        cut_a, cut_b = common_ends(np.cumsum(of.size_a[ids_a]), np.cumsum(of.size_b[ids_b]), last_a, last_b)
        self.stops = np.searchsorted(cut_a, last_a) + 1  # groups up to the end of each text
        self.codes = ids_a[cut_a] * PAIR_BASE + ids_b[cut_b]
        # texts of groups: tokens of A, then of B, each with the sign that follows it
        group_a = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=-1))
        group_b = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=-1))
        va, vb = len(of.bytes_a), len(of.bytes_b)
        sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        sign_a[cut_a], sign_b[cut_b], sign_b[last_b] = 1, 1, 2
        words = np.empty(len(ids_a) + len(ids_b), np.int64)
        words[np.arange(len(ids_a)) + np.concatenate(([0], cut_b[:-1] + 1))[group_a]] = ids_a + sign_a * va
        words[np.arange(len(ids_b)) + (cut_a + 1)[group_b]] = ids_b + sign_b * vb + 2 * va
        self.words, self.ends, self.names = words, last_a + last_b + 2, of.texts

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, str]]:
        """Tokens of A, tokens of B, link numbers and group digest of each text."""
        begin = at = 0
        for n_a, n_b, stop, end in zip(self.n_a.tolist(), self.n_b.tolist(), self.stops.tolist(), self.ends.tolist()):
            text = "".join(map(self.names.__getitem__, self.words[at:end].tolist()))
            yield n_a, n_b, self.codes[begin:stop], hashlib.sha256(text.encode()).hexdigest()
            begin, at = stop, end


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(df: DataFrame, id_col: str, text_col: str, json_path: str, model_path: str) -> DataFrame:
    """Per text its groups' digest and its links as places in its cell; per cell its different pairs.

    Rows of texts have `places` and `times` (unsigned 32-bit integers); a cell's own row has `pairs` and `counts`.
    """
    rows = id_and_text(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    schema = f"cell long, doc_id {kind.simpleString()}, {_FIELDS}, places binary, times binary, pairs array<long>, counts array<long>"
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    zeros = (0, 0, np.zeros(0, np.int64), "")

    def closed(cell: int, held: list) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate([h[3] for h in held])
        pairs, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
        at, places, times = 0, [], []
        for h in held:
            mine, often = np.unique(place[at : at + len(h[3])], return_counts=True)
            at += len(h[3])
            places.append(mine.astype("<u4").tobytes())
            times.append(often.astype("<u4").tobytes())
        sizes = [len(h[3]) for h in held]
        nothing = [None] * len(held)
        longs = pa.list_(pa.int64())
        columns = [
            pa.array([cell] * len(held), pa.int64()),
            pa.array([h[0] for h in held], id_type),
            pa.array([h[1] for h in held], pa.int64()),
            pa.array([h[2] for h in held], pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array([h[4] for h in held], pa.string()),
            pa.array(places, pa.binary()),
            pa.array(times, pa.binary()),
            pa.array(nothing, longs),
            pa.array(nothing, longs),
        ]
        names = [part.split()[0] for part in schema.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names)
        if len(pairs):
            lists = [pa.array([cell], pa.int64()), pa.nulls(1, id_type), *(pa.nulls(1, c.type) for c in columns[2:9])]
            offsets = pa.array([0, len(pairs)], pa.int32())
            lists += [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int64))) for v in (pairs, counts)]
            yield pa.RecordBatch.from_arrays(lists, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(json_path, model_path)
        cell, held, links = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                encoded = [of.encode(t) for t in batch.column(1).to_pylist()]
                full = [e for e in encoded if len(e[0])]
                found = Aligned(of, full).rows() if full else iter(())
                for doc, e in zip(batch.column(0).to_pylist(), encoded):
                    row = (doc, *(next(found) if len(e[0]) else zeros))
                    if held and links + len(row[3]) > CELL_LINKS:
                        yield from closed(cell, held)
                        cell, held, links = cell + 1, [], 0
                    held.append(row)
                    links += len(row[3])
        if held:
            yield from closed(cell, held)

    return rows.mapInArrow(run, schema)


def alignment(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, model_path: str | None = None
) -> DataFrame:
    """`doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256` of every text."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = written(aligned(df, id_col, text_col, json_path, model_path), "aligned")
    texts = rows.where("pairs is null").drop("pairs", "counts")
    of_cell = rows.where("pairs is not null").select("cell", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    of_cell = of_cell.select("cell", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    # a pair has one row per cell here, so no key is hot
    counted = of_cell.withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).withColumn("b", F.col("pair") % PAIR_BASE)
    best = counted.groupBy("b").agg(F.max("total").alias("top"))  # one row per id of the piece model
    back = counted.join(F.broadcast(best), "b").select(F.col("cell").alias("home"), "place", "total", (F.col("total") == F.col("top")).alias("best"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def meet(docs: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("place").to_numpy())
        total = found.column("total").to_numpy()[order]
        top = found.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist()):
            at, often = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(often[top[at]].sum()) if len(at) else 0)
            count_sum.append(int((often * total[at]).sum()) if len(at) else 0)
        columns = {name: docs.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table(columns | {"groups_sha256": docs.column("groups_sha256")})

    return texts.groupBy("cell").cogroup(back.groupBy("home")).applyInArrow(meet, schema)
