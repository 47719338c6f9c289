"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Texts become 64-bit fingerprints of word shingles. Equal fingerprints collapse first. Pairs within
the Hamming budget agree on one of `budget + 1` bit blocks, so each fingerprint enters the trie once
per block with that block as its leading bits; the node of those bits is where the joint descent
starts. From there pairs of nodes are walked together: equal next bits keep the budget, differing
ones spend one, and a pair without budget is pruned. A start node with too many rows is split on
Spark by the same rule (children with equal bits keep the budget, others spend it) until each part
fits a task, so no bucket is capped. At most 1 + 64 + 2016 fingerprints lie within two bits of one,
so the links are linear in the number of different fingerprints.

`simhash_groups` is that join on one fingerprint with a small budget: precise, and blind to copies
with more than a few edits. `near_copies` finds those too. There a text gets several parts of single
bits of minima over its set of five-word shingles: a bit differs with half the chance that two texts do
not share a shingle, so with sixteen parts of 48 bits and three bits of budget a pair at a similarity of
0.8 meets in some part with a chance of 0.995. Each part goes through the same trie join, but parts only
propose: a link stays where the sets of shingles themselves have a similarity of 0.8 or more. The trie's
links are a forest, so a refused link may have stood for others: where the proposed links of a component
end up in several groups, its texts are compared by what they differ in from the component's common core.
Those near the core are linked to the closest one; other near copies share rare differences and meet there,
so that no link between groups is left out and a family of many like texts is not expanded into its pairs.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows
share a component; a null id never names a component unless nothing else is in it; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, hex64, id_and_text, per_text, written

#: Seed of the shingle hash, part of the fingerprint's definition.
SEED = 42
#: Most rows of one start node that a task walks; larger nodes are split by their next bits.
NODE_ROWS = 50_000
#: Bits by which a too large node is split at a time.
SPLIT_BITS = 4
#: Depth from which nodes are not split: 256 values at most lie below each side.
DEEPEST = 56
#: Shingles whose bits are unpacked at once.
CHUNK = 65_536


def shingle_hashes(text: str | None, words_per: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= words_per:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - words_per + 1].tolist()
    stops = (ends[words_per - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: str | None, words_per: int = 3) -> int:
    """Majority bit of all shingle hashes, as a signed long; zero without words."""
    hashes = shingle_hashes(text, words_per)
    if not len(hashes):
        return 0
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        part = np.concatenate((part, np.zeros(-len(part) % 255, np.uint64)))
        rows = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += rows.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return ones


#: Parts, bits and budget of the wider fingerprint.
PARTS, PART_BITS, PART_BUDGET = 16, 48, 3
#: Pairs whose whole fingerprints differ in more than this share of bits are not compared by shingles:
#: at a similarity of 0.8 a tenth differs, with a standard deviation of 0.011.
SPURIOUS = 0.16
#: Least similarity of near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Factors and offsets of the orders whose minima give the bits, part of the fingerprint's definition.
_FACTORS, _OFFSETS = (
    np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, (2, PARTS * PART_BITS), np.uint64).astype(np.uint32)
)
_FACTORS |= np.uint32(1)


def wide_fingerprint(text: str | None, words_per: int = 5) -> list[int]:
    """`PARTS` numbers of `PART_BITS` bits; all zero without words."""
    hashes = np.unique(shingle_hashes(text, words_per))
    if not len(hashes):
        return [0] * PARTS
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(PARTS * PART_BITS, 0xFFFFFFFF, np.uint32)
    room = np.empty((128, PARTS * PART_BITS), np.uint32)
    for at in range(0, len(short), 128):
        part = short[at : at + 128, None]
        order = np.multiply(part, _FACTORS, out=room[: len(part)])
        order += _OFFSETS
        np.minimum(least, order.min(0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    least = (least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39)
    bits = (least >> np.uint32(31)).astype(bool).reshape(PARTS, PART_BITS)
    padded = np.concatenate((bits, np.zeros((PARTS, 64 - PART_BITS), bool)), 1).astype(np.uint8)
    return np.packbits(padded, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have a Jaccard similarity of `SIMILAR` or more."""
    part, whole = SIMILAR
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 3) -> DataFrame:
    """One row `(doc_id, fp)` per document."""
    return per_text(id_and_text(df, id_col, text_col), "fp long", lambda text: (fingerprint(text, words_per),))


def walk_pairs(values: np.ndarray, first: np.ndarray, second: np.ndarray, budget: np.ndarray) -> tuple:
    """Index pairs of `values` within the budget, by joint descent from pairs of value ranges.

    `first` and `second` are (n, 2) arrays of ranges; equal ranges mean a node against itself.
    Values of a range are sorted and unsigned. All pairs of one depth advance together.
    """
    a, b, left = first, second, budget
    out_a, out_b = [], []
    for bit in range(63, -1, -1):
        zero = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1) == 0)))
        mid_a = a[:, 0] + zero[a[:, 1]] - zero[a[:, 0]]
        mid_b = b[:, 0] + zero[b[:, 1]] - zero[b[:, 0]]
        own = a[:, 0] == b[:, 0]
        a0, a1 = np.stack((a[:, 0], mid_a), 1), np.stack((mid_a, a[:, 1]), 1)
        b0, b1 = np.stack((b[:, 0], mid_b), 1), np.stack((mid_b, b[:, 1]), 1)
        a = np.concatenate((a0, a1, a0, a1[~own]))
        b = np.concatenate((b0, b1, b1, b0[~own]))
        left = np.concatenate((left, left, left - 1, left[~own] - 1))
        size_a, size_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        live = (left >= 0) & (size_a > 0) & (size_b > 0) & ~((a[:, 0] == b[:, 0]) & (size_a == 1))
        single = live & (size_a == 1) & (size_b == 1)
        if single.any():  # two leaves: their remaining bits settle them at once
            below = np.uint64((1 << bit) - 1)
            x, y = a[single, 0], b[single, 0]
            near = np.bitwise_count((values[x] ^ values[y]) & below) <= left[single]
            out_a.append(x[near])
            out_b.append(y[near])
        live &= ~single
        a, b, left = a[live], b[live], left[live]
        if not len(a):
            break
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those links that join two trees: as many as needed to keep the components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x, y


#: Columns that name a node pair of the trie.
NODE = ["block", "depth", "pa", "pb"]


def _blocks(budget: int, bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each block."""
    edges = [round(bits * k / (budget + 1)) for k in range(budget + 2)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _start_nodes(prints: DataFrame, budget: int, bits: int) -> DataFrame:
    """Each value once per block, turned so that the block leads; `block` also tells the part."""
    starts = []
    for k, (lo, width) in enumerate(_blocks(budget, bits)):
        turned = F.shiftleft("fp", lo).bitwiseOR(F.shiftrightunsigned("fp", bits - lo)) if lo else F.col("fp")
        turned = F.shiftleft(turned, 64 - bits) if bits < 64 else turned  # bits pushed out at the top are gone
        head = F.shiftrightunsigned(turned, 64 - width)
        starts.append(
            F.struct(
                (F.col("part") * 16 + k).alias("block"),
                F.lit(width).alias("depth"),
                head.alias("pa"),
                head.alias("pb"),
                turned.alias("turned"),
            )
        )
    rows = prints.select("part", "fp", F.explode(F.array(*starts)).alias("n")).select("fp", "n.*")
    return rows.withColumns({"side": F.lit(0), "left": F.lit(budget)})


def _split(rows: DataFrame, budget: int) -> DataFrame:
    """Children of node pairs: equal next bits keep the budget, each differing bit spends one."""
    masks = [m for m in range(1 << SPLIT_BITS) if bin(m).count("1") <= budget]
    grown = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    grown = grown.withColumn("cost", F.bit_count("mask")).where("cost <= left")
    own = F.expr(f"shiftrightunsigned(shiftleft(turned, depth), {64 - SPLIT_BITS})")
    grown = grown.withColumn("own", own).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    self_pair = F.col("pa") == F.col("pb")
    swap = F.when(self_pair, F.col("own") > F.col("other")).otherwise(F.col("side") == 1)
    head = lambda p: F.shiftleft(p, SPLIT_BITS)
    return grown.select(
        "fp",
        "block",
        (F.col("depth") + SPLIT_BITS).alias("depth"),
        head("pa").bitwiseOR(F.when(swap, F.col("other")).otherwise(F.col("own"))).alias("pa"),
        head("pb").bitwiseOR(F.when(swap, F.col("own")).otherwise(F.col("other"))).alias("pb"),
        "turned",
        swap.cast("int").alias("side"),
        (F.col("left") - F.col("cost")).alias("left"),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each node pair with itself and keep a forest; rows come sorted by node pair, side and turned value."""
    names = ["fp", "block", "depth", "pa", "pb", "turned", "side", "left"]

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        fp, block, depth, pa_, pb_, turned, side, left = rows
        n = len(fp)
        change = np.ones(n, bool)
        change[1:] = (block[1:] != block[:-1]) | (depth[1:] != depth[:-1]) | (pa_[1:] != pa_[:-1]) | (pb_[1:] != pb_[:-1])
        start = np.nonzero(change)[0]
        stop = np.append(start[1:], n)
        ones = np.concatenate(([0], np.cumsum(side)))
        cut = stop - (ones[stop] - ones[start])
        same = pa_[start] == pb_[start]
        first = np.stack((start, np.where(same, stop, cut)), 1)
        second = np.stack((np.where(same, start, cut), stop), 1)
        use = (first[:, 1] > first[:, 0]) & (second[:, 1] > second[:, 0]) & (stop - start > 1)
        low = np.where(depth >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(depth, 63).astype(np.uint64))
        values = turned.view(np.uint64) & low
        x, y = walk_pairs(values, first[use], second[use], left[start][use].astype(np.int64))
        kept = list(forest(x, y))
        x = np.array([k[0] for k in kept], np.int64)
        y = np.array([k[1] for k in kept], np.int64)
        columns = [pa.array(c, pa.int64()) for c in (block[x] // 16, fp[x], fp[y])]
        return pa.RecordBatch.from_arrays(columns, ["part", "a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        n = len(held[0])
        if not n:
            continue
        last = np.ones(n, bool)
        for k in (1, 2, 3, 4):
            last &= held[k] == held[k][-1]
        cut = n - int(last.sum())  # the last node pair may go on in the next batch
        if cut:
            yield links([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield links(held)


def linked_fingerprints(prints: DataFrame, budget: int = 2, bits: int = 64, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links `(part, a, b)` of different values `(part, fp)`; they keep every component within the budget."""
    rows = written(_start_nodes(prints, budget, bits), "trie")
    found = None
    while True:
        sizes = rows.groupBy(*NODE).agg(F.count("*").alias("n"))
        plural = sizes.where("n > 1")
        fit = rows.join(plural.where(f"n <= {node_rows} or depth >= {DEEPEST}").select(*NODE), NODE, "left_semi")
        dealt = fit.repartition(*NODE).sortWithinPartitions(*NODE, "side", F.col("turned").bitwiseXOR(F.lit(-(2**63))))
        part = dealt.mapInArrow(_walk, "part long, a long, b long")
        found = part if found is None else found.unionByName(part)
        hot = plural.where(f"n > {node_rows} and depth < {DEEPEST}").select(*NODE)
        if hot.isEmpty():
            return found
        rows = written(_split(rows.join(hot, NODE, "left_semi"), budget), "trie")


def near_groups(prints: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """`(doc_id, fp)` plus `component_id`, the least id reachable over links within the budget."""
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    values = own.select(F.lit(0).alias("part"), "fp")
    tree = written(components(linked_fingerprints(values, budget, 64, node_rows)), "roots")
    placed = own.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(placed.join(names, "root").select("fp", "component_id"), "fp")


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 3, budget: int = 2
) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Returns `doc_id`, `fingerprint` (16 hex digits) and `component_id`.
    """
    prints = written(fingerprints(df, id_col, text_col, words_per), "prints")
    return near_groups(prints, budget).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links `(a, b)` whose sets `set_a`, `set_b` are similar."""
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
        keep = pa.array([similar(x, y) for x, y in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _accepted(links: DataFrame, classes: DataFrame, texts: DataFrame, words_per: int) -> DataFrame:
    """Those links `(a, b)` of nodes whose texts are near copies, by the shingles themselves."""
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("node").alias(side), F.col("fps").alias(f"fps_{side}")), side)
    apart = F.aggregate(F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    links = written(links.where(apart <= int(SPURIOUS * PARTS * PART_BITS)).select("a", "b"), "proposed")
    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).distinct()
    asked = texts.join(ends, "doc_id", "left_semi")
    sets = written(per_text(asked, "shingles binary", lambda t: (np.unique(shingle_hashes(t, words_per)).tobytes(),)), "shingles")
    for side in ("a", "b"):
        links = links.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    kept = written(links.select("a", "b", "set_a", "set_b").mapInArrow(_judge, "a long, b long"), "accepted")
    discard(sets)
    return kept


def _placed(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the `root` of their component."""
    tree = written(components(links), "roots")
    return classes.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _between(links: DataFrame, placed: DataFrame) -> DataFrame:
    """The different links `(a, b)` of roots that the links `(a, b)` of nodes leave: those inside a component go."""
    for side in ("a", "b"):
        links = links.join(placed.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
    return links.where("root_a <> root_b").select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct()


def _differences(nodes: DataFrame, texts: DataFrame, words_per: int) -> DataFrame:
    """Nodes `(node, root, whole)` with the `tokens` their shingles differ by from the core of their component.

    The core is the set of shingles that over half the nodes hold. `over` is nine times the number of tokens less the
    `size` of the set: two texts are near copies exactly where their differences have at least an eighteenth of both
    `over` in common. Where that is not above zero they are near copies whatever they share.
    """
    asked = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    made = per_text(asked, "shingles array<bigint>", lambda t: (np.unique(shingle_hashes(t, words_per)).view(np.int64).tolist(),))
    sets = written(made.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").withColumnRenamed("doc_id", "node"), "sets")
    held = sets.select("whole", F.explode("shingles").alias("token")).groupBy("whole", "token").agg(F.count("*").alias("n"))
    most = held.join(sets.groupBy("whole").agg(F.count("*").alias("all")), "whole").where("2 * n > all")
    # written, so that the sets need not be dealt by component for the sake of the core
    core = written(most.groupBy("whole").agg(F.collect_list("token").alias("core")), "core")
    known = sets.join(core, "whole", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    apart = F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    out = known.select("node", "root", "whole", F.size("shingles").alias("size"), apart.alias("tokens"))
    return written(out.withColumn("over", 9 * F.size("tokens") - F.col("size")), "differences")


def _open_links(placed: DataFrame, texts: DataFrame, proposed: DataFrame, words_per: int) -> tuple[DataFrame, DataFrame]:
    """Links `(a, b)` of near copies, and those to be judged, which with them leave out no near copies of different roots.

    Only components of `proposed` that fell into several roots count; they are found on the links between roots, so what
    is accepted is not searched again. Nodes close to the core of their component are linked to the closest one. Any
    other pair of near copies shares some of its differences from the core: it meets at the rarest of these, if that
    leaves enough to share behind it on both sides. Edits that a text has for itself come
    first and meet nothing, so pairs arise where edits are shared, and not within all of a family.
    """
    reach = written(components(_between(proposed, placed)), "reach").toDF("root", "whole")
    nodes = written(placed.select("node", "root").join(reach, "root"), "open")
    away = _differences(nodes, texts, words_per)
    closest = away.groupBy("whole").agg(F.min(F.struct("over", "node")).alias("closest"))
    away = away.join(closest, "whole").withColumn("far", F.col("over") + F.col("closest.over") > 0)
    star = away.where("not far and node <> closest.node").select(F.col("node").alias("a"), F.col("closest.node").alias("b"))
    # least number of shared tokens with any near copy: sizes differ by a quarter at most, and one side of a pair is far
    least = F.ceil(F.size("tokens") - F.col("size") / 4)
    least = F.greatest(F.lit(1), least, F.when(~F.col("far"), F.ceil((F.col("over") - F.col("closest.over")) / 18)))
    each = away.select("whole", "node", "root", "size", "over", "far", least.alias("least"), F.size("tokens").alias("d"), F.explode("tokens").alias("token"))
    counts = each.groupBy("whole", "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "token"))
    # tokens that may follow, this one included
    left = each.join(counts, ["whole", "token"]).withColumn("rest", F.col("d") - place + 1)
    left = written(left.where("n > 1 and rest >= least").drop("least", "d", "n"), "rarest")
    sides = [left.withColumnsRenamed({c: f"{c}_{s}" for c in left.columns if c not in ("whole", "token")}) for s in "ab"]
    near = sides[0].join(sides[1], ["whole", "token"]).where(
        """node_a > node_b and root_a <> root_b and (far_a or far_b)
           and 5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)
           and 18 * least(rest_a, rest_b) >= over_a + over_b"""
    )
    return star, near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per: int = 5, numbered: bool = False
) -> DataFrame:
    """`(doc_id, fps, component_id)` of every document, linked where five-word shingles have a similarity of 0.8 or more.

    With `numbered`, ids are known to be different longs that do not change when `df` is read again;
    then texts are not written a second time.
    """
    given = id_and_text(df, id_col, text_col)
    if numbered:
        made = per_text(given, "fps array<bigint>", lambda t: (wide_fingerprint(t, words_per),))
        wide, texts = written(made.withColumn("row", F.col("doc_id")), "wide"), given
    else:
        made = per_text(given, "fps array<bigint>, text string", lambda t: (wide_fingerprint(t, words_per), t))
        wide = written(made.withColumn("row", F.monotonically_increasing_id()), "wide")
        texts = wide.select(F.col("row").alias("doc_id"), "text")
    # texts with one whole fingerprint are one class, and its first row, the node, speaks for it
    classes = written(wide.groupBy("fps").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("node")), "classes")
    values = classes.select("node", F.posexplode("fps").alias("part", "fp"))
    heads = written(values.groupBy("part", "fp").agg(F.min("node").alias("head")), "heads")
    equal = values.join(heads, ["part", "fp"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = linked_fingerprints(heads.select("part", "fp"), PART_BUDGET, PART_BITS)
    for side in ("a", "b"):
        head = heads.select("part", F.col("fp").alias(side), F.col("head").alias(f"head_{side}"))
        near = near.join(head, ["part", side])
    links = equal.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    kept = _accepted(links, classes, texts, words_per)
    placed = written(_placed(classes, kept), "placed")
    star, asked = _open_links(placed, texts, links, words_per)
    more = star.unionByName(_accepted(asked, classes, texts, words_per))
    more = written(_between(more, placed), "more")
    if not more.isEmpty():  # components grow together by the links between them alone
        tree = written(components(more), "roots").toDF("root", "whole")
        placed = placed.join(tree, "root", "left").withColumn("root", F.coalesce("whole", "root"))
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return wide.select("doc_id", "fps").join(placed.join(names, "root").select("fps", "component_id"), "fps")


__all__ = ["fingerprint", "fingerprints", "linked_fingerprints", "near_copies", "near_groups", "simhash_groups"]
