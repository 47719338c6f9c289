"""Repeated byte strings by suffix arrays that are built group by group.

Strings of `length` bytes that start at two places are found in three steps.

1. Anchors: every window of bytes has its least-hashed `GRAM` bytes as an anchor, so equal strings
   share one. Anchors found once anywhere are done with.
2. Around every anchor found twice lies a snippet, the bytes of strings it stands for. Snippets of one
   anchor that are equal settle each other by hash. What is left are anchors with different snippets,
   the edges of copies; one snippet of each kind is fetched.
3. Snippets of an anchor meet in one task. They are cut into symbols of eight bytes from the anchor
   backward; what follows from the anchor on is one symbol more, its rank, as equal strings hold their
   anchor at the same place. The suffix array of the symbols is built in linear time: suffixes are
   grouped by their Lyndon prefixes, groups are processed in descending order with previous-smaller
   pointers, and the order within groups is then emitted from the least suffix on, without renaming.
   Strings with a symbol bound inside are equal where a run of the array shares enough bytes to the
   right and the few bytes to the left agree, which gives back single bytes.

Anchors with more than `CLASS_SNIPPETS` different snippets do not fit a task; their strings are
compared by hashes of 96 bits instead. Equal anchors within a batch and equal snippets within a cell
are settled on the spot, so a hot passage sends few rows. Texts stay in their cells.

Edge cases: null and empty texts have no bytes; texts shorter than `length` keep all; repeated rows
lose all their strings of full length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .cells import celled, found_twice, meet, slices
from .common import release, written
from .substring_cover import PLACES, places, window_hashes

#: Bytes of a string, of an anchor, and of a symbol.
LENGTH, GRAM, SYMBOL = 200, 32, 8
#: Different snippets of one anchor that a task orders.
CLASS_SNIPPETS = 20_000
#: Symbols of one suffix array; an anchor's snippets are never parted.
BLOCK = 60_000
#: Pairs of neighbours in the array that are compared at once.
CHUNK = 16_384
#: Characters of text a task hashes at once.
SLICE = 4_000_000

SPANS = "cell long, row long, start int, stop int"


def suffix_order(text: list[int]) -> list[int]:
    """Suffix array of positive numbers; the end counts as the least symbol."""
    values = np.array([*text, 0], np.int64)
    n = len(values)
    by = np.argsort(values, kind="stable")
    head = np.concatenate(([True], values[by][1:] != values[by][:-1]))
    at = np.empty((2, n), np.int64)
    at[:, by] = np.arange(n), np.maximum.accumulate(np.where(head, np.arange(n), 0))
    order, place, start, size = by.tolist(), at[0].tolist(), at[1].tolist(), np.bincount(at[1], minlength=n).tolist()
    before = [-1] * n
    last = n - 1
    while last >= 0:
        first = start[order[last]]
        if first == last:  # a group of one moves one suffix at most
            i = order[last]
            p = i - 1
            while p >= 0 and start[p] >= first:
                p = before[p]
            before[i] = p
            last -= 1
            if p >= 0 and size[group := start[p]] > 1:
                size[group] -= 1
                end = group + size[group]
                size[end] = 1
                q, k = order[end], place[p]
                order[end], order[k] = p, q
                place[p], place[q] = end, k
                start[p] = end
            continue
        members = sorted(order[first : last + 1])
        pointed: dict[int, int] = {}
        for i in members:  # the nearest suffix before it in a lesser group
            p = i - 1
            while p >= 0 and start[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, dict[int, list[int]]] = {}
            for p, count in pointed.items():
                by_count.setdefault(count, {}).setdefault(start[p], []).append(p)
            for count in sorted(by_count, reverse=True):
                for group, moved in by_count[count].items():
                    if size[group] == len(moved):
                        continue
                    # those pointed at go to the upper end of their group, as a group of their own
                    end = group + size[group]
                    fresh = end - len(moved)
                    size[group] -= len(moved)
                    size[fresh] = len(moved)
                    for p in moved:
                        end -= 1
                        q = order[end]
                        k = place[p]
                        order[end], order[k] = p, q
                        place[p], place[q] = end, k
                        start[p] = fresh
        last = first - 1
    result = [-1] * n
    result[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    front = list(range(n))  # next free place of each group, by its start
    for k in range(n):
        i = result[k] - 1
        while i >= 0 and not done[i]:
            at = front[start[i]]
            front[start[i]] = at + 1
            result[at] = i
            done[i] = True
            i = before[i]
    return result[1:]


def common_lengths(text: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix of the order shares with the one ahead of it."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            top = n - max(i, j)
            while h < top and text[i + h] == text[j + h]:
                h += 1
            out[k] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def _equal_bytes(rights: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that `rights[i]` and `rights[j]` share from their begin on; the zeros put behind short ones may count."""
    width = max(map(len, rights), default=0) + 1
    flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rights), np.uint8).reshape(-1, width)
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), CHUNK):
        differs = flat[i[at : at + CHUNK]] != flat[j[at : at + CHUNK]]
        out[at : at + CHUNK] = np.where(differs.any(1), differs.argmax(1), width)
    return out


def repeated_spans(snippets: list[tuple[bytes, int, int, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For snippets `(bytes, offset of the anchor, class, text, begin)`: number of the snippet, first byte and end of
    the runs covered by strings that stand elsewhere in the class too.

    Equal strings hold the anchor at the same place, so what follows it from the anchor on is one symbol, the rank among
    all such rests, and no suffix begins behind it. Snippets of one text may overlap, so strings count once per place in their text.
    """
    anchor = np.array([s[1] for s in snippets], np.int64)
    ahead = anchor // SYMBOL  # whole symbols before the anchor
    before = np.frombuffer(b"".join(s[0][s[1] % SYMBOL : s[1]] for s in snippets), ">u8")
    rests = [s[0][s[1] :] for s in snippets]
    ranked = sorted(set(rests))
    number = {r: k for k, r in enumerate(ranked)}
    rank = np.array([number[r] for r in rests], np.int64)
    names, named = np.unique(before, return_inverse=True)
    stop = np.cumsum(ahead + 1)
    of = np.repeat(np.arange(len(snippets)), ahead + 1)
    place = anchor[of] - SYMBOL * (stop[of] - 1 - np.arange(len(of)))
    symbols = np.zeros(len(of), np.int64)
    last = np.zeros(len(of), bool)
    last[stop - 1] = True
    symbols[~last], symbols[last] = named + 1, rank + len(names) + 1
    text = symbols.tolist()
    order = suffix_order(text)
    shared = np.array(common_lengths(text, order), np.int64)
    order = np.array(order)
    lengths = np.array([len(s[0]) for s in snippets])
    # bytes shared with the suffix ahead: symbols before the anchor, then the equal bytes of the rests, within the snippets;
    # a suffix that shares less than all up to its anchor is short of a string whatever follows
    i, j = order[1:], order[:-1]
    s, t = of[i], of[j]
    reached = (shared[1:] >= stop[s] - 1 - i) & (stop[s] - i == stop[t] - j)
    span = np.zeros(len(i), np.int64)
    s, t = s[reached], t[reached]
    met = anchor[s] - place[i[reached]] + _equal_bytes(ranked, rank[s], rank[t])
    span[reached] = np.minimum(met, np.minimum(lengths[s] - place[i[reached]], lengths[t] - place[j[reached]]))
    lcp = np.concatenate(([0], span))
    classes, texts, begins = (np.array([s[k] for s in snippets], np.int64) for k in (2, 3, 4))
    base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    flat = np.frombuffer(b"".join(s[0] for s in snippets), np.uint8)
    owners, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in range(SYMBOL):
        run = np.cumsum(lcp < length - back)
        s, p = of[order], place[order]
        # only the first symbol bound inside a string speaks for it, and a string alone in its run for none
        fits = (p - back >= 0) & (p - back + length <= lengths[s])
        fits &= np.bincount(run, weights=fits)[run] > 1
        run, s, p = run[fits], s[fits], p[fits]
        left = np.zeros(len(p), np.uint64)
        for b in range(1, back + 1):
            left = left * np.uint64(256) + flat[base[s] + p - b].astype(np.uint64)
        # sort by string, then by place; a string with two places is repeated
        spot = (begins[s] + p - back, texts[s])
        by = np.lexsort((*spot, left, classes[s], run))
        new, moved = np.zeros(len(by), bool), np.zeros(len(by), bool)
        new[:1] = True
        for column in (run, classes[s], left):
            new[1:] |= column[by][1:] != column[by][:-1]
        for column in spot:
            moved[1:] |= column[by][1:] != column[by][:-1]
        group = np.cumsum(new) - 1
        twice = np.bincount(group, weights=moved & ~new)[group] > 0 if len(by) else moved
        owners.append(s[by][twice])
        starts.append((p - back)[by][twice])
    owner, start = np.concatenate(owners), np.concatenate(starts)
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (start[1:] - start[:-1] > length))
    first, last = (np.concatenate(k)[: len(owner)] for k in (([0], cut + 1), (cut, [len(owner) - 1])))
    return owner[first], start[first], start[last] + length


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` over each run of `width` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def anchors_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of a text, and the first and last string each stands for."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashes = window_hashes(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), GRAM)
    width = length - GRAM + 1
    least = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    at = np.flatnonzero(most == hashes)
    # runs of strings with one least hash; an anchor's strings are the part of its run in reach of it
    head = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    tail = np.concatenate((head[1:] - 1, [len(least) - 1]))
    first, last = np.full(len(at), len(data)), np.full(len(at), -1)
    run = np.searchsorted(head, np.maximum(0, at - width + 1), "right") - 1
    todo = np.arange(len(at))
    while len(todo):
        r, p = run[todo], at[todo]
        mine = least[head[r]] == hashes[p]
        first[todo] = np.where(mine, np.minimum(first[todo], np.maximum(head[r], p - width + 1)), first[todo])
        last[todo] = np.where(mine, np.maximum(last[todo], np.minimum(tail[r], p)), last[todo])
        run[todo] += 1
        todo = todo[(run[todo] < len(head)) & (head[np.minimum(run[todo], len(head) - 1)] <= p)]
    return hashes[at], at, first, last


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                cell, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                found = [anchors_of(t.encode(), length) for t in batch.column(2).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                keys, pos = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield places(keys, np.zeros(len(keys), np.int32), cell[at], row[at], pos)

    return run


def _texts(table: pa.Table) -> dict[int, bytes]:
    return {r: t.encode() for r, t in zip(table.column("row").to_pylist(), table.column("text").to_pylist())}


SNIPPETS = "key long, kind long, known boolean, cell long, row long, pos int, begin int, size int"


def _kinds(length: int):
    """Hash of the snippet around each anchor; equal ones of a cell stand for each other."""

    def one(texts: pa.Table, found: pa.Table) -> pa.Table:
        data = _texts(texts) if found.num_rows else {}
        places_of: dict[int, list[int]] = {}
        for r, p in zip(found.column("row").to_pylist(), found.column("pos").to_pylist()):
            places_of.setdefault(r, []).append(p)
        c = found.column("cell")[0].as_py() if found.num_rows else 0
        out, seen = [], {}
        for r, wanted in places_of.items():
            text = data[r]
            _, at, first, last = anchors_of(text, length)
            k = np.searchsorted(at, np.array(sorted(wanted)))
            for p, begin, stop in zip(at[k].tolist(), first[k].tolist(), (last[k] + length).tolist()):
                key = xxhash.xxh64_intdigest(text[p : p + GRAM], 7)
                # the anchor stands at the same place in equal snippets
                kind = xxhash.xxh64_intdigest(text[begin:stop], 1 + p - begin)
                row = [key - 2**63, kind - 2**63, False, c, r, p, begin, stop - begin]
                if (key, kind) in seen:
                    out[seen[key, kind]][2] = True
                    row[:3] = None, None, True
                else:
                    seen[key, kind] = len(out)
                out.append(row)
        names = [s.split(" ")[0] for s in SNIPPETS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(zip(names, types))})

    return one


def _fetch():
    """The bytes of chosen snippets."""

    def one(texts: pa.Table, chosen: pa.Table) -> pa.Table:
        data = _texts(texts) if chosen.num_rows else {}
        got = [data[r][b : b + n] for r, b, n in zip(*(chosen.column(c).to_pylist() for c in ("row", "begin", "size")))]
        columns = {n: chosen.column(n) for n in ("key", "cell", "row", "pos", "begin")}
        columns["data"] = pa.array(got, pa.binary())
        return pa.table(columns)

    return one


def _order(length: int):
    """Suffix arrays over runs of whole anchors; rows come sorted by anchor."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        numbers = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in rows))}
        owner, start, stop = repeated_spans([(r[5], r[3] - r[4], numbers[r[0]], r[2], r[4]) for r in rows], length)
        cell, row, begin = (np.array([r[k] for r in rows], np.int64)[owner] for k in (1, 2, 4))
        columns = [cell, row, (begin + start).astype(np.int32), (begin + stop).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if symbols > BLOCK and row[0] != held[-1][0]:
                    yield settle(held)
                    held, symbols = [], 0
                held.append(row)
                symbols += (row[3] - row[4]) // SYMBOL + 1
        if held:
            yield settle(held)

    return run


def _string_rows(length: int):
    """Hashes of all strings around anchors with very many different snippets."""

    def one(texts: pa.Table, chosen: pa.Table) -> pa.Table:
        parts = []
        data = _texts(texts) if chosen.num_rows else {}
        todo: dict[int, set[int]] = {}
        cell = chosen.column("cell").to_pylist()[0] if chosen.num_rows else 0
        for r, begin, size in zip(*(chosen.column(c).to_pylist() for c in ("row", "begin", "size"))):
            todo.setdefault(r, set()).update(range(begin, begin + size - length + 1))
        for r, starts in todo.items():
            at = np.array(sorted(starts), np.int64)
            values = np.frombuffer(data[r], np.uint8).astype(np.uint64) + np.uint64(1)
            checks = (window_hashes(values, length, 1)[at] & np.uint64(0x7FFFFFFF)).astype(np.int32)
            parts.append((window_hashes(values, length)[at], checks, np.full(len(at), r), at))
        if not parts:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        keys, checks, rows, pos = (np.concatenate(p) for p in zip(*parts))
        return pa.Table.from_batches([places(keys, checks, np.full(len(keys), cell), rows, pos)])

    return one


def _cut(kind: pa.DataType):
    def one(texts: pa.Table, gone: pa.Table) -> pa.Table:
        of: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in zip(*(gone.column(c).to_pylist() for c in ("row", "start", "stop"))):
            of.setdefault(r, []).append((a, b))
        out = []
        for r, data in _texts(texts).items():
            kept, end, runs, removed = [], 0, 0, 0
            for a, b in sorted(of.get(r, ())):
                if a > end or not runs:
                    kept.append(data[end:a])
                    runs, removed = runs + 1, removed + b - a
                    end = b
                elif b > end:
                    removed, end = removed + b - end, b
            kept.append(data[end:])
            out.append((len(data), removed, runs, b"".join(kept)))
        n, removed, runs, kept = zip(*out) if out else ((), (), (), ())
        return pa.table(
            {
                "doc_id": texts.column("doc_id").cast(kind),
                "n_bytes": pa.array(n, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return one


def without_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    class_snippets: int = CLASS_SNIPPETS,
) -> DataFrame:
    """Every document without the bytes of strings of `length` that also start elsewhere.

    Returns `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` and `kept` (the bytes left).
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings need {2 * GRAM} bytes at least")
    spark = df.sparkSession
    cells = celled(df, id_col, text_col)
    texts = cells.select("cell", "row", "text")
    anchors = written(found_twice(texts.mapInArrow(_anchor_rows(length), PLACES)), "anchors")
    release(spark)
    kinds = meet(texts, anchors, _kinds(length), SNIPPETS)
    of_key, of_kind = Window.partitionBy("key"), Window.partitionBy("key", "kind")
    kinds = kinds.withColumn("key", F.coalesce("key", F.xxhash64("row", "pos"))).withColumn(
        "kind", F.coalesce("kind", F.xxhash64("pos", "row"))
    )
    kinds = kinds.withColumns({"least": F.min("kind").over(of_key), "most": F.max("kind").over(of_key)})
    nth = F.row_number().over(of_kind.orderBy("row", "pos"))
    kinds = kinds.withColumns({"n": F.count(F.lit(1)).over(of_kind), "nth": nth})
    open_kind = (F.col("n") == 1) & ~F.col("known")
    kinds = kinds.withColumns(
        {"classes": F.sum(F.when(F.col("nth") == 1, 1)).over(of_key), "open": F.max(open_kind).over(of_key)}
    )
    kinds = written(kinds, "kinds")
    release(spark)
    settled = kinds.where("n > 1 or known").select(
        "cell", "row", F.col("begin").alias("start"), (F.col("begin") + F.col("size")).cast("int").alias("stop")
    )
    mixed = kinds.where("open and least <> most and nth = 1")
    few = mixed.where(F.col("classes") <= class_snippets).select("cell", "row", "pos", "key", "begin", "size")
    snippets = meet(texts, few, _fetch(), "key long, cell long, row long, pos int, begin int, data binary")
    ordered = snippets.repartition("key").sortWithinPartitions("key").mapInArrow(_order(length), SPANS)
    gone = settled.unionByName(ordered)
    many = kinds.where(F.col("classes") > class_snippets).select("cell", "row", "begin", "size")
    if not many.isEmpty():
        twice = found_twice(meet(texts, many, _string_rows(length), PLACES))
        gone = gone.unionByName(
            twice.select("cell", "row", F.col("pos").alias("start"), (F.col("pos") + length).cast("int").alias("stop"))
        )
    gone = written(gone, "gone")
    release(spark)
    field = cells.schema["doc_id"].dataType
    shape = f"doc_id {field.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return meet(cells, gone, _cut(to_arrow_type(field)), shape)
