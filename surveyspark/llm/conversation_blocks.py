"""Structure repair of conversations by block tables (Four Russians).

A conversation is repaired by the cheapest edits that make its roles an optional system turn and then
user and assistant in turns. A row becomes one of nine symbols: role (system, user, assistant, other)
with or without truncation, or "must go" for blank and repeated rows. The cost still to pay from each
of four states (start, after system, after user, after assistant) is a vector; less its minimum, only
few such vectors exist. A table holds, for every vector and every block of `BLOCK` symbols, the vector
before the block and the cost it adds, so a conversation is priced block by block from its end. Then
each block is expanded backward from the vector behind it, and the edits are traced forward; of equally
cheap edits the least letter is taken, which gives the least audit, as every letter has one outcome.

Spark does the rest. Copies of a row are counted before they are shuffled, repeats of a text found by a
join with its first turn, and the order made by range partitions, so a long conversation is sorted by
many tasks. Its rows are then packed as one byte each into chunks of `CHUNK` rows; only these bytes of a
conversation meet in one task, a byte per row as in the audit itself. Texts are shuffled once, sorted,
and streamed with the edits, never held. The digest of a conversation is one hash over its repaired
texts in order, which one task must read one after the other; `repair` has no such step beyond the order.

Edge cases: a null role or text is one blank (so the row is blank or has an unknown role); null turns
come first; rows of one turn are ordered by role, then by the MD5 of their text; a null id is a
conversation of its own; a role's first character counts, and a row with an empty role has none, so it
is never kept as it is; texts of any length are streamed; repeated rows are duplicates from the second
on; conversations without rows are in the audit with zeros; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, written

#: Symbols of a block, and rows whose symbols make one chunk.
BLOCK, CHUNK = 4, 1 << 16
#: Prices of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the only role that may be inserted or given leads.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where keeping a role leads; -1 where it may not stand.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
ROLES = "sua"
#: Symbols: twice the role's place (3: other), one more if truncated; then blank and duplicate rows.
GOES, SYMBOLS = 8, 9
BLANK, DUPLICATE = 8, 9
NAME = {USER: "user", ASSISTANT: "assistant"}


def closed(costs: list[int]) -> list[int]:
    """Costs from each state when roles may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return costs


#: Cost still to pay behind the last row.
END = tuple(closed([0, 99, 99, 0]))


def choices(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """Edits of a row from a state, in the order of their letters: letter, price, next state."""
    out = [("D", DELETE, q)]
    if symbol < GOES:
        extra = CUT * (symbol % 2)
        role = symbol // 2
        if role < 3 and KEPT[ROLES[role]][q] >= 0:
            out.append(("K", extra, KEPT[ROLES[role]][q]))
        out.append(("R", REROLE + extra, NEXT[q]))
    return out


def before(symbol: int, behind: tuple[int, ...]) -> list[int]:
    """Costs before a row from the costs behind it."""
    return closed([min(price + behind[to] for _, price, to in choices(symbol, q)) for q in range(4)])


class Tables:
    """Normalised vectors, their transitions by one symbol and by whole blocks."""

    def __init__(self):
        self.vectors = [END]
        number = {END: 0}
        step, added = [], []
        for vector in self.vectors:  # grows while new vectors appear
            row, more = [], []
            for symbol in range(SYMBOLS):
                costs = before(symbol, vector)
                low = min(costs)
                reached = tuple(c - low for c in costs)
                if reached not in number:
                    number[reached] = len(self.vectors)
                    self.vectors.append(reached)
                row.append(number[reached])
                more.append(low)
            step.append(row)
            added.append(more)
        self.step, self.added = np.array(step), np.array(added)
        # blocks of one symbol more: the new symbol stands before the block
        to, cost = np.arange(len(step))[:, None], np.zeros((len(step), 1), int)
        for _ in range(BLOCK):
            to, cost = (
                np.stack([self.step[to, s] for s in range(SYMBOLS)], 1).reshape(len(step), -1),
                np.stack([cost + self.added[to, s] for s in range(SYMBOLS)], 1).reshape(len(step), -1),
            )
        self.block, self.price = to.tolist(), cost.tolist()
        self.traced: dict[tuple[int, bytes, int], tuple[str, int]] = {}

    def expand(self, behind: int, symbols: bytes, q: int) -> tuple[str, int]:
        """Letters of the edits of a block entered in state `q`, and the state it leaves."""
        known = self.traced.get((behind, symbols, q))
        if known is not None:
            return known
        vectors = [behind]
        for symbol in reversed(symbols):
            vectors.append(int(self.step[vectors[-1], symbol]))
        vectors.reverse()
        letters, state = [], q
        for symbol, here, there in zip(symbols, vectors, vectors[1:]):
            now, later = self.vectors[here], self.vectors[there]
            low = int(self.added[there, symbol])
            while True:
                due = now[state] + low
                options = [(letter, to, price + later[to]) for letter, price, to in choices(symbol, state)]
                options.append(("I", NEXT[state], INSERT + now[NEXT[state]] + low))
                letter, state = min((letter, to) for letter, to, cost in options if cost == due)
                letters.append(letter)
                if letter != "I":
                    break
        self.traced[behind, symbols, q] = "".join(letters), state
        return self.traced[behind, symbols, q]

    def edits(self, symbols: bytes) -> tuple[int, list[str]]:
        """Least cost, and the letters of every block in order; the last piece stands behind all rows."""
        head = len(symbols) % BLOCK
        begins = range(head, len(symbols), BLOCK)
        vector, cost = 0, 0
        behind = []
        for begin in reversed(begins):
            behind.append(vector)
            code = 0
            for symbol in symbols[begin : begin + BLOCK]:
                code = code * SYMBOLS + symbol
            cost += self.price[vector][code]
            vector = self.block[vector][code]
        first = vector
        for symbol in reversed(symbols[:head]):
            cost += int(self.added[vector, symbol])
            vector = int(self.step[vector, symbol])
        cost += self.vectors[vector][START]
        pieces, state = [], START
        for known, part in itertools.chain([(first, symbols[:head])], zip(reversed(behind), (symbols[b : b + BLOCK] for b in begins))):
            letters, state = self.expand(known, part, state)
            pieces.append(letters)
        pieces.append("I" * (END[state] // INSERT))
        return cost, pieces


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    """The block tables of this Python worker."""
    return Tables()


def damage_number(conv_id: str, turn: str) -> Column:
    """What happens to a row: crc32 of `conv_id:turn` modulo 20, a null as one blank."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.pmod(F.crc32(F.concat(as_text[0], F.lit(":"), as_text[1]).cast("binary")), F.lit(20))


def plain(df: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` with a blank for a null role or text."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), *blank)


def damaged(df: DataFrame) -> DataFrame:
    """Rows with reproducible faults: dropped, emptied, without full stops, repeated, or from the user."""
    rows = plain(df).withColumn("kind", damage_number("conv_id", "turn")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _chunks(rows: DataFrame) -> DataFrame:
    """The symbols of each conversation in order, in chunks that begin at a known place."""
    stripped = F.rtrim("text", F.lit(BLANK_CHARS))
    role = F.greatest(F.lit(0), F.instr(F.lit(ROLES), F.substring("role", 1, 1)))
    role = F.when(F.substring("role", 1, 1) == "", 3).otherwise(F.when(role == 0, 3).otherwise(role - 1))
    cut = (~F.substring(stripped, -1, 1).isin(".", "!", "?")).cast("int")
    symbol = F.when(stripped == "", BLANK).otherwise(2 * role + cut).cast("int")
    keys = ["conv_id", "turn", "role", "digest"]
    light = rows.select("conv_id", "turn", "role", _digest().alias("digest"), symbol.alias("symbol"))
    light = light.groupBy(*keys, "symbol").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = light.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    facts = light.join(firsts, same).select(*keys, "symbol", "n", (place != F.col("first")).alias("again"))
    # written, since a range partition reads its input twice
    ordered = written(facts, "turns").repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "digest", "ordinal", "symbols"]
    schema = f"conv_id {kind}, turn long, role string, digest binary, ordinal long, symbols binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, ordinal, start, done = 0, 0, None, []

        def close():
            nonlocal held, size, ordinal, start
            if size:
                done.append((*start, ordinal, b"".join(held)))
            held, size, start, ordinal = [], 0, None, ordinal + 1

        def out(types: list[pa.DataType]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            done.clear()
            return batch

        types = None
        for batch in batches:
            types = types or [*(c.type for c in batch.columns[:4]), pa.int64(), pa.binary()]
            for *key, symbol, n, again in zip(*(c.to_pylist() for c in batch.columns)):
                if start is not None and start[0] != key[0]:
                    close()
                first = symbol if symbol == BLANK or not again else DUPLICATE
                copies = BLANK if symbol == BLANK else DUPLICATE
                while n:
                    start = start or tuple(key)
                    take = min(n, CHUNK - size)
                    held.append(bytes([first]) + bytes([copies]) * (take - 1))
                    first, n, size = copies, n - take, size + take
                    if size == CHUNK:
                        close()
                if len(done) >= 4096:
                    yield out(types)
        close()
        if types:
            yield out(types)

    return ordered.mapInArrow(run, schema)


def _edits(chunks: DataFrame) -> DataFrame:
    """Per chunk the letters of its edits; costs and counts of a conversation stand on its first chunk."""
    key = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"), "role", "digest", "ordinal", "turn", "symbols")
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(key)).alias("chunks"))
    kind = chunks.schema["conv_id"].dataType.simpleString()
    counts = "blank long, duplicate long, truncated long, cost long"
    schema = f"conv_id {kind}, turn long, role string, digest binary, ordinal long, edits string, {counts}"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tables()
        for batch in batches:
            rows = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols = b"".join(p["symbols"] for p in parts)
                cost, pieces = of.edits(symbols.replace(bytes([DUPLICATE]), bytes([GOES])))
                facts = [symbols.count(bytes([s])) for s in (BLANK, DUPLICATE)]
                facts += [sum(symbols.count(bytes([2 * r + 1])) for r in range(4)), cost]
                audit, at = "".join(pieces), 0
                for k, p in enumerate(parts):
                    # the letters of as many rows as the chunk has; the last chunk takes all that is left
                    stop = _stop(audit, at, len(p["symbols"])) if k < len(parts) - 1 else len(audit)
                    rows.append((conv, p["turn"], p["role"], p["digest"], p["ordinal"], audit[at:stop], *(facts if k == 0 else [0] * 4)))
                    at = stop
            types = [batch.column(0).type, pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return whole.mapInArrow(run, schema)


def _stop(audit: str, at: int, rows: int) -> int:
    """Where the letters of `rows` rows from `at` on end."""
    while True:
        part = audit[at : at + rows]
        at += len(part)
        rows = part.count("I")
        if not rows:
            return at


def _merged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's mark, the letters of its chunks, and its rows, sorted so that letters come first."""
    letters = _edits(_chunks(rows)).withColumn("kind", F.lit(1)).withColumn("text", F.lit(None).cast("string"))
    texts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.lit(2).alias("kind"), "text")
    marks = ids.select("conv_id").distinct().withColumn("kind", F.lit(0))
    union = letters.unionByName(texts, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    sort = ["conv_id", "turn", "role", "digest", "kind", "ordinal"]
    names = ["conv_id", "turn", "role", "kind", "text", "edits", "blank", "duplicate", "truncated", "cost"]
    return union.repartition("conv_id").sortWithinPartitions(*sort).select(*names)


class Edited:
    """Streams one conversation: letters first, then rows; gives what becomes of each."""

    def __init__(self):
        self.letters, self.at, self.state = "", 0, START

    def more(self, letters: str) -> None:
        self.letters, self.at = self.letters[self.at :] + letters, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", NAME[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[role[:1]][self.state]
        elif letter == "R":
            self.state = NEXT[self.state]
            role = NAME[self.state]
        yield letter, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def repair(df: DataFrame) -> DataFrame:
    """The edits of all rows in order: `conv_id, place, edit, role, text`; a deleted row keeps its own role."""
    rows = plain(df)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, stream, place = object(), Edited(), 0
        id_type = pa.null()
        done: list[tuple] = []

        def put(events) -> None:
            nonlocal place
            for event in events:
                done.append((conv, place, *event))
                place += 1

        def out() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*done)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            done.clear()
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for key, _, role, what, text, letters, *_ in zip(*(c.to_pylist() for c in batch.columns)):
                if what == 0:
                    put(stream.rest())
                    conv, stream, place = key, Edited(), 0
                elif what == 1:
                    stream.more(letters)
                else:
                    put(stream.row(role, text))
            yield out()
        put(stream.rest())
        if done:
            yield out()

    return _merged(rows, rows).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def audit(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every conversation of `originals`."""
    rows = plain(rows)
    kind = originals.schema["conv_id"].dataType.simpleString()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *longs, "audit", "repaired_sha256"]

    class Conversation(Edited):
        def __init__(self, conv):
            super().__init__()
            self.conv, self.digest, self.empty, self.audit = conv, hashlib.sha256(), True, []
            self.first = self.last = self.before = None
            self.turns = self.illegal = 0
            self.counts = [0, 0, 0, 0]

        def take(self, events) -> None:
            for letter, role, text in events:
                if letter != "D":
                    self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "replace"))
                    self.empty = False

        def see(self, turn, role: str, text: str) -> None:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if self.before is not None:
                self.illegal += self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
            self.take(self.row(role, text))

        def result(self) -> tuple:
            self.take(self.rest())
            gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
            blank, duplicate, truncated, cost = self.counts
            facts = (gaps, blank, duplicate, truncated, self.illegal, cost)
            return (self.conv, *facts, "".join(self.audit), self.digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, id_type, done = None, pa.null(), []

        def out() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            columns = list(zip(*done)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            done.clear()
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for key, turn, role, what, text, letters, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                if what == 0:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(key)
                elif what == 1:
                    now.more(letters)
                    now.audit.append(letters)
                    now.counts = [a + b for a, b in zip(now.counts, counts)]
                else:
                    now.see(turn, role, text)
            yield out()
        if now is not None:
            done.append(now.result())
            yield out()

    fields = ", ".join(f"{n} long" for n in longs)
    return _merged(rows, originals).mapInArrow(run, f"conv_id {kind}, {fields}, audit string, repaired_sha256 string")
