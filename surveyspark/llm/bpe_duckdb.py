"""Byte-level BPE by recursive queries, inside Spark's tasks.

Spark partitions the documents; each task cuts its texts into pre-tokens and hands the different
ones to an in-process DuckDB connection. There a word is one row per token, in order. Each round of
a recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost
pair of least rank, until no pair is left. A word of more than `PIECE` bytes is cut into pieces that are
encoded as words; then every joint is proved or mended (see `_joined`), so rounds and rows grow with
the length of a word, not with its square, and the ids are those of the uncut word. Decoding joins ids
with the vocabulary and concatenates by an ordered aggregation. Encoded words are kept in a bounded
cache of the Python worker. Texts of Latin letters only are cut by a plain pattern that spells out the same
character classes, all others by the general one.

Edge cases: a null text is empty; an empty text has no ids and decodes to no bytes; repeated rows
give repeated results; an empty table gives an empty result; other columns are not read. Texts are
encoded whole; a word of any length is contracted in the same way.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import id_and_text

#: Words a worker keeps encoded; beyond it the cache starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of new words encoded by one recursive query.
QUERY_BYTES = 1_000_000
#: Characters cut into words before the new ones are encoded.
SLICE_CHARS = 4_000_000
#: Ids decoded by one ordered aggregation.
QUERY_IDS = 1_000_000

#: Bytes of the pieces that a longer word is cut into.
PIECE = 64
#: Tokens on each side of a joint that are encoded anew first, where the joint does not hold.
REACH = 4

#: Letters, digits and white space below U+0250; texts with other numbers or characters take the general pattern.
LETTER, DIGIT, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9", " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
PLAIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
NOT_PLAIN = re.compile("[²³¹¼-¾ɐ-\U0010ffff]")

#: A row's key is its word's number times 2^32 plus the place of its first byte in the word.
ROUNDS = """
with recursive state(step, key, id) as (
    select 0, key, id from symbols
    union all
    (
    with pairs as (
        select step, key, key >> 32 as word, id, lag(key) over w as before,
               case when lead(key) over w >> 32 = key >> 32 then id::bigint * 1048576 + lead(id) over w end as pair
        from state window w as (order by key)
    ), best as (
        select p.word, min(m.rank::bigint * 4294967296 + (p.key & 4294967295)) as least
        from pairs p join merges m on m.pair = p.pair group by p.word
    )
    select o.step + 1, o.key, case when b.least & 4294967295 = o.key & 4294967295 then (b.least >> 32)::integer else o.id end
    from pairs o join best b using (word)
    where o.before is null or o.before <> (o.word << 32 | (b.least & 4294967295))
    )
), last as (
    select key >> 32 as word, max(step) as step from state group by 1
)
select s.key >> 32 as word, s.id
from state s join last t on t.word = s.key >> 32 and t.step = s.step
order by s.key
"""

DECODE = """
select row_no, string_agg(chars, '') as chars
from (select t.row_no, v.chars from ids t join vocabulary v using (id) order by t.pos)
group by row_no
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One DuckDB connection with the merge table and the vocabulary of a rank file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        splits = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        a, b, rank = (np.array(c, np.int32) for c in zip(*splits))
        self.con = duckdb.connect(config={"threads": 1})
        merges = pa.table({"pair": a.astype(np.int64) * 1048576 + b, "rank": rank})
        words = sorted(ranks.items(), key=lambda item: item[1])
        vocabulary = pa.table({"id": pa.array([r for _, r in words], pa.int32()), "chars": [t.decode("latin-1") for t, _ in words]})
        self.bytes_of = {rank: token for token, rank in words}
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("given", rows)
            self.con.execute(f"create table {name} as select * from given")
            self.con.unregister("given")
        self.of_byte = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by one recursive query."""
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        self.con.register("symbols", pa.table({"key": (word << 32) + pos, "id": ids}))
        result = self.con.sql(ROUNDS).to_arrow_table()
        self.con.unregister("symbols")
        values = result.column("id").to_numpy().astype("<u4").tobytes()
        sizes = np.bincount(result.column("word").to_numpy(), minlength=len(words))
        ends = (4 * np.cumsum(sizes)).tolist()
        return [values[i:j] for i, j in zip([0, *ends], ends)]

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by queries of about `QUERY_BYTES` bytes."""
        out: list[bytes] = []
        todo, size = [], 0
        for k, w in enumerate(words):
            todo.append(w)
            size += len(w)
            if size >= QUERY_BYTES or k == len(words) - 1:
                out += self._contract(todo)
                todo, size = [], 0
        return out

    def _holds(self, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], bool]:
        """Whether two neighbouring tokens come out again where their bytes are encoded together."""
        ordered = sorted(pairs)
        found = self._contracted([self.bytes_of[a] + self.bytes_of[b] for a, b in ordered])
        return {pair: ids == np.array(pair, "<u4").tobytes() for pair, ids in zip(ordered, found)}

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words from those of their pieces; all words share each round's queries.

        A row of tokens is the encoding of its bytes if each two neighbours are that of theirs: the first
        contraction across a border would be the first one of these two tokens alone as well, since the
        least pair, leftmost first, stays the least among fewer. So only joints are looked at. Where one
        does not hold, the tokens around it are encoded anew, over a reach that doubles until both ends
        hold; stretches that meet become one.
        """
        cuts = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in words]
        kinds = sorted({c for cut in cuts for c in cut})
        ids = dict(zip(kinds, (np.frombuffer(b, "<u4") for b in self._contracted(kinds))))
        rows = [np.concatenate([ids[c] for c in cut]) for cut in cuts]
        joints = {k: np.cumsum([len(ids[c]) for c in cut])[:-1] for k, cut in enumerate(cuts)}
        known: dict[tuple[int, int], bool] = {}
        reach = REACH
        while joints:
            sides = {k: list(zip(rows[k][at - 1].tolist(), rows[k][at].tolist())) for k, at in joints.items()}
            fresh = {pair for pairs in sides.values() for pair in pairs} - known.keys()
            known.update(self._holds(fresh))
            stretches: list[list[int]] = []  # word, first token, end
            for k, at in joints.items():
                for j, pair in zip(at.tolist(), sides[k]):
                    if known[pair]:
                        continue
                    low, high = max(0, j - reach), min(len(rows[k]), j + reach)
                    if stretches and stretches[-1][0] == k and low <= stretches[-1][2]:
                        stretches[-1][2] = high
                    else:
                        stretches.append([k, low, high])
            raw = [b"".join(map(self.bytes_of.__getitem__, rows[k][i:j].tolist())) for k, i, j in stretches]
            anew: dict[int, list] = {}
            for (k, low, high), b in zip(stretches, self._contracted(raw)):
                anew.setdefault(k, []).append((low, high, np.frombuffer(b, "<u4")))
            joints = {}
            for k, changes in anew.items():
                parts, borders, at, size = [], [], 0, 0
                for low, high, new in changes:
                    parts += [rows[k][at:low], new]
                    borders += [size + low - at, size + low - at + len(new)]
                    size, at = borders[-1], high
                rows[k] = np.concatenate([*parts, rows[k][at:]])
                joints[k] = np.array([j for j in borders if 0 < j < len(rows[k])], np.int64)
            reach *= 2
        return [row.astype("<u4").tobytes() for row in rows]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not yet known."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        raw = [(w, w.encode()) for w in words]
        for encode_all, group in (
            (self._contracted, [r for r in raw if len(r[1]) <= PIECE]),
            (self._joined, [r for r in raw if len(r[1]) > PIECE]),
        ):
            self.known.update(zip([w for w, _ in group], encode_all([b for _, b in group])))

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids (unsigned 32-bit little-endian)."""
        out = [b""] * len(rows)
        at = 0
        while at < len(rows):
            stop, size = at, 0
            while stop < len(rows) and (stop == at or size + len(rows[stop]) // 4 <= QUERY_IDS):
                size += len(rows[stop]) // 4
                stop += 1
            lengths = np.array([len(r) // 4 for r in rows[at:stop]])
            ids = np.frombuffer(b"".join(rows[at:stop]), "<u4").astype(np.int32)
            given = pa.table(
                {
                    "row_no": np.repeat(np.arange(at, stop, dtype=np.int32), lengths),
                    "pos": np.arange(len(ids), dtype=np.int32),
                    "id": ids,
                }
            )
            self.con.register("ids", given)
            back = self.con.sql(DECODE).to_arrow_table()
            for k, chars in zip(back.column(0).to_pylist(), back.column(1).to_pylist()):
                out[k] = chars.encode("latin-1")
            self.con.unregister("ids")
            at = stop
        return out


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The coder of this Python worker."""
    return Coder(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def _encoded(of: Coder, pattern: regex.Pattern, texts: list[str]) -> list[bytes]:
    """Ids of each text; words are cut and learnt for a slice of texts at a time."""
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE_CHARS):
            size += len(texts[stop])
            stop += 1
        cut = [(pattern if NOT_PLAIN.search(t) else PLAIN).findall(t) for t in texts[at:stop]]
        known = of.known.get
        parts = [list(map(known, words)) for words in cut]
        gaps = [[i for i, p in enumerate(row) if p is None] if None in row else [] for row in parts]
        fresh = {words[i] for words, row in zip(cut, gaps) for i in row}
        if fresh:
            of.learn(fresh)
            known = of.known.__getitem__
            for words, row, gap in zip(cut, parts, gaps):
                for i in gap:
                    row[i] = known(words[i])
        out += map(b"".join, parts)
        at = stop
    return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """`(doc_id, ids)`: the token ids of every whole text, as an array of longs."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pattern = coder(path), regex.compile(public_tokenizers.PATTERN)
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").astype(np.int64) for b in _encoded(of, pattern, _texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<bigint>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """`(doc_id, bytes)`: the bytes of arrays of ids; a null array has none."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = df.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = coder(path)
        for batch in batches:
            ids = [np.array(i or [], "<u4").tobytes() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.decode(ids), pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None
) -> DataFrame:
    """Encode every text and decode its ids again, in one pass over the documents.

    Returns `doc_id`, `n_tokens`, `ids_sha256` (ids as unsigned 32-bit little-endian) and
    `decoded_sha256`.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = id_and_text(df, id_col, text_col)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pattern = coder(path), regex.compile(public_tokenizers.PATTERN)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = _encoded(of, pattern, _texts(batch))
                back = of.decode(ids)
                columns = [
                    batch.column(0),
                    pa.array([len(b) // 4 for b in ids], pa.int64()),
                    pa.array(map(digest, ids), pa.string()),
                    pa.array(map(digest, back), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
