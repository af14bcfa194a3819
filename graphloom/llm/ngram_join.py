"""N-gram Jaccard join with signature trees.

1. Every different shingle set is known by a digest.  Two sets whose similarity reaches the threshold share
   one of their first shingles in any fixed order (prefix filter), so sets meet by shingle.  The order puts
   frequent shingles, found by a sketch of counters of fixed size, last: lines that many documents share
   hardly ever bring sets together.  A count by shingle comes next; a filter of those counted more than once
   keeps the others out of further shuffles.
2. Shingles that are met by the same sets propose the same pairs; one of them stays for each group of sets.
3. In each group a signature tree is built: leaves hold a bitmap and the size of a set, inner nodes the
   OR-combined bitmaps and size ranges of their children.  A dual traversal prunes node pairs whose
   largest possible overlap is too small; what is left falls into loose clusters, which are merged over
   the groups.
4. The sets of each loose cluster are fetched, and a second traversal verifies pairs exactly.  Pairs that
   verified links connect already are skipped, as they cannot change the components.

Groups of more than BLOCK_SETS sets are dealt out in blocks that share a hub (see `_linked`), in both traversals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import bounded_batches, discard, join_skewed, key_filter, materialise, may_contain, slices, table, texts
from graphloom.llm._words import LOWER, NOT_SPACE, grams, mix, words_of
from graphloom.llm.components import components

WORDS = 5
#: Jaccard similarity of a link: overlap * DENOMINATOR >= union * NUMERATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Sets, and bytes of shingles, that one task holds at once; larger groups are dealt out in blocks.
BLOCK_SETS, BLOCK_BYTES = 1000, 16 << 20
_FANOUT = 8


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the rows: first row, offsets (rows + 1) and the sorted different shingle hashes of each row."""
    for low, high in slices(column):
        buf, off = texts(column.slice(low, high - low))
        words = words_of(buf, off, NOT_SPACE, LOWER)
        at, h = grams(words, n)
        doc, count = words.doc[at], np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):  # the whole sequence is the one shingle
            whole = np.array([int(np.bitwise_xor.reduce(mix(words.hash[words.first[d] : words.first[d + 1]] * np.arange(3, 2 * count[d] + 3, 2, dtype=np.uint64)))) for d in short], np.uint64)
            doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(whole + count[short].astype(np.uint64))])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        yield low, np.searchsorted(doc, np.arange(high - low + 1)), h


def digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    """Shingles of a set of n, in a fixed order, of which any similar set has one among its own first ones."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def _based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, node (digest of the set)."""
    for batch in batches:
        n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for low, off, h in shingle_sets(batch.column(1)):
            n[low : low + len(off) - 1] = np.diff(off)
            node[low : low + len(off) - 1] = [digest(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node)], ["doc_id", "n", "node"])


#: Counters of the sketch of frequent shingles (a power of two).
SKETCH = 1 << 22


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(13) & np.uint64(SKETCH - 1)).astype(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n: counters of this task that stand out, counting every different set's prefix once."""
    seen: set[int] = set()
    counts = np.zeros(SKETCH, np.uint32)
    for batch in batches:
        for _, off, h in shingle_sets(batch.column(1)):
            for a, b in zip(off[:-1], off[1:], strict=True):
                if a < b and (node := digest(h[a:b])) not in seen:
                    seen.add(node)
                    counts[_bucket(h[a : a + prefix_length(int(b - a))])] += 1
            if len(seen) > 500_000:
                seen.clear()
    mean = counts.mean()
    high = np.flatnonzero(counts >= 3 + mean + 6 * np.sqrt(mean))
    yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(counts[high], pa.int64())], ["key", "n"])


def _prefix(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the fixed order: those in frequent counters last, else by hash."""
    late = frequent[_bucket(h)]
    return np.concatenate([h[~late], h[late]])[: prefix_length(len(h))] if late.any() else h[: prefix_length(len(h))]


def _keys(frequent: Broadcast, only: Broadcast | None):
    """key, node, n (shingles of the set) for the prefix of every set (of the keys in the filter `only`); a set comes once a task (but for what a full memory forgets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, off, h in shingle_sets(batch.column(1)):
                keys, nodes, sizes = [], [], []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    if a < b and (node := digest(h[a:b])) not in seen:
                        seen.add(node)
                        keys.append(_prefix(h[a:b], frequent.value))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                        sizes.append(np.full(len(keys[-1]), b - a, np.int32))
                if keys:
                    key, node, size = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
                    if only is not None:
                        use = may_contain(only.value, key)
                        key, node, size = key[use], node[use], size[use]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(size)], ["key", "node", "n"])
                if len(seen) > 500_000:
                    seen.clear()

    return run


def bitmap(shingles: np.ndarray) -> bytes:
    """Signature of a set: a bitmap of a power of two bits, two for each shingle at least; wider ones fold into narrower ones."""
    width = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _filtered(only: Broadcast):
    """Rows whose key the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_contain(only.value, batch.column("key").to_numpy(zero_copy_only=False))))

    return run


def _fetched(only: Broadcast, form: Callable[[np.ndarray], bytes]):
    """node, n, data of the sets in the filter `only`: data is form(set); a set comes once a task (but for what a full memory forgets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, off, h in shingle_sets(batch.column(1)):
                rows = []
                for a, b in zip(off[:-1], off[1:], strict=True):
                    if a < b and (node := digest(h[a:b])) not in seen and may_contain(only.value, np.array([node]))[0]:
                        seen.add(node)
                        rows.append((node, int(b - a), form(h[a:b])))
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], ["node", "n", "data"])
                if len(seen) > 500_000:
                    seen.clear()

    return run


def _packed(shingles: np.ndarray) -> bytes:
    return shingles.tobytes()


@dataclass
class TreeNode:
    """bits of `width`: OR of all below; low..high: sizes below; excess: most shingles that a set below has beyond its bits; first: a row below."""

    bits: int
    width: int
    low: int
    high: int
    excess: int
    first: int
    children: list[TreeNode] = field(default_factory=list)
    uniform: bool = True


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class SignatureTree:
    """Signature tree over sets: rows number the sets; sizes and bitmaps by row."""

    def __init__(self, rows: list[int], sizes: list[int], bitmaps: list[bytes]) -> None:
        nodes = []
        for r in sorted(rows, key=lambda r: (sizes[r], bitmaps[r])):
            bits = int.from_bytes(bitmaps[r], "little")
            nodes.append(TreeNode(bits, 8 * len(bitmaps[r]), sizes[r], sizes[r], sizes[r] - bits.bit_count(), r))
        while len(nodes) > 1:
            nodes = [self._parent(nodes[k : k + _FANOUT]) for k in range(0, len(nodes), _FANOUT)]
        self.root = nodes[0] if nodes else None

    @staticmethod
    def _parent(children: list[TreeNode]) -> TreeNode:
        if len(children) == 1:
            return children[0]
        width = min(c.width for c in children)
        bits = excess = 0
        for c in children:
            folded = _fold(c.bits, c.width, width)
            bits |= folded
            # a fold can only lose bits that a set had: at most as many as it has shingles
            excess = max(excess, c.excess if c.width == width else c.high)
        return TreeNode(bits, width, min(c.low for c in children), max(c.high for c in children), excess, children[0].first, children, False)


def may_overlap(a: TreeNode, b: TreeNode) -> bool:
    """Whether a set below a and one below b can be similar, by sizes and by the largest possible overlap."""
    if DENOMINATOR * b.high < NUMERATOR * a.low or DENOMINATOR * a.high < NUMERATOR * b.low:
        return False
    if a.width > b.width:
        a, b = b, a
    common = (a.bits & _fold(b.bits, b.width, a.width)).bit_count()
    excess = min(a.excess, b.excess) if a.width == b.width else a.excess
    return (NUMERATOR + DENOMINATOR) * (common + excess) >= NUMERATOR * (a.low + b.low)


class Clusters:
    """Union-find over the rows of a group, joined by a dual traversal of signature trees."""

    def __init__(self, n: int, test: Callable[[int, int], bool]) -> None:
        self.parent = list(range(n))
        self.test = test

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def traverse(self, a: TreeNode, b: TreeNode) -> None:
        """Join the similar rows below a and b; nodes whose rows are all joined already aren't entered."""
        if a is b:
            for c in a.children:
                self.traverse(c, c)
            for k, c in enumerate(a.children):
                for d in a.children[k + 1 :]:
                    self.traverse(c, d)
            if a.children and all(c.uniform for c in a.children):
                a.uniform = len({self.find(c.first) for c in a.children}) == 1
            return
        if a.uniform and b.uniform and self.find(a.first) == self.find(b.first) or not may_overlap(a, b):
            return
        if not a.children and not b.children:
            if self.test(a.first, b.first):
                self.parent[max(self.find(a.first), self.find(b.first))] = min(self.find(a.first), self.find(b.first))
        elif a.children and (not b.children or a.high - a.low >= b.high - b.low):
            for c in a.children:
                self.traverse(c, b)
        else:
            for c in b.children:
                self.traverse(a, c)

    def run(self, sizes: list[int], bitmaps: list[bytes], side: list[int]) -> None:
        """All rows against each other, or, if there are two sides, the rows of one against those of the other."""
        parts = sorted(set(side))
        trees = [SignatureTree([r for r, s in enumerate(side) if s == p], sizes, bitmaps).root for p in parts]
        if len(trees) == 1:
            self.traverse(trees[0], trees[0])
        elif len(trees) == 2:
            self.traverse(*trees)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of the same key, from rows sorted by key; columns beside the key come as tuples."""
    now, rows = None, []
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in keys]
        for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in rest), strict=True), strict=True):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], names)


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loose links a, b: each set of a loose cluster with the first one of it."""
    out: list[tuple[int, int]] = []
    for _, rows in _groups(batches, ["key", "pair"]):
        nodes, sizes, bitmaps, side = (list(c) for c in zip(*dict.fromkeys(rows), strict=True))
        found = Clusters(len(nodes), lambda a, b: True)
        found.run(sizes, bitmaps, side)
        out += [(nodes[k], nodes[r]) for k in range(len(nodes)) if (r := found.find(k)) != k]
        if len(out) > 10_000:
            yield _emit(out, ["a", "b"])
            out = []
    yield _emit(out, ["a", "b"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b from each set to the first of those it is connected with in its group."""
    out = []
    for _, rows in _groups(batches, ["cluster", "pair"]):
        rows = list({(r[0], r[2]): r for r in rows}.values())
        sets = [np.frombuffer(s, np.uint64) for _, s, _ in rows]
        found = Clusters(len(rows), lambda a, b, sets=sets: similar(sets[a], sets[b]))
        found.run([len(s) for s in sets], [bitmap(s) for s in sets], [side for _, _, side in rows])
        out += [(rows[k][0], rows[r][0]) for k in range(len(rows)) if (r := found.find(k)) != k]
        if len(out) > 10_000:
            yield _emit(out, ["a", "b"])
            out = []
    yield _emit(out, ["a", "b"])


def _list_digest(node: str) -> list[F.Column]:
    """Columns that tell lists of nodes apart: two 32-bit halves of a hash, summed."""
    h = F.xxhash64(node)
    return [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s1"), F.sum(F.shiftrightunsigned(h, 32)).alias("s2"), F.min(node).alias("lo"), F.max(node).alias("hi")]


def _dealt(index: DataFrame, keep: list[str]) -> DataFrame:
    """Each row once, in a block (pair) of its group; the group's hub comes in every block."""
    own = F.array(F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return index.select(*keep, "node", F.explode(F.when(F.col("node") == F.col("hub"), every).otherwise(own)).alias("pair"), F.lit(0).cast("long").alias("side"))


def _dealt_again(index: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """The rows that are left over (rest: key, node; side 0) against all rows of their group (side 1), in pairs of blocks."""
    counts = rest.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("parts"))
    sizes = index.select(key, "blocks").distinct().join(counts, key)
    steps = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block, part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(8)), F.col("parts"))
    left = join_skewed(rest.select(key, "node"), sizes, [key]).withColumn("o", F.explode(steps("blocks"))).select(key, "node", (part * F.col("blocks") + F.col("o")).alias("pair"), F.lit(0).cast("long").alias("side"))
    every = join_skewed(index.select(key, "node"), sizes, [key]).withColumn("o", F.explode(steps("parts"))).select(key, "node", (F.col("o") * F.col("blocks") + block).alias("pair"), F.lit(1).cast("long").alias("side"))
    return left.unionByName(every)


def _linked(index: DataFrame, key: str, payload: Callable[[DataFrame], DataFrame], columns: list[str], find) -> tuple[DataFrame, DataFrame | None]:
    """(links a, b; their components, where they had to be found) of the sets of each group, as `find` links them inside a block.

    index (written): key, node, blocks, hub.  A group of several blocks is dealt out, its hub to every block, so
    what a block connects with the hub is connected over all blocks.  Only sets that links of any group don't
    connect with the hub are left over; they meet all sets of their group in pairs of blocks.  Links among sets
    that are connected already are not needed, so nothing is lost, and a group of near copies costs its size.
    payload: from the nodes (key) that are needed to node and the columns that find reads.
    """
    kept = [c for c in columns if c in index.columns and c != "node"]

    def run(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
        rows = dealt.join(payload(nodes), "node").select(columns)
        return materialise(rows.repartition(key, "pair").sortWithinPartitions(key, "pair").mapInArrow(find, "a long, b long"), "links")

    links = run(_dealt(index, kept), index.select(F.col("node").alias("key")))
    hot = index.where("blocks > 1")
    if hot.isEmpty():
        return links, None
    labels = materialise(components(links), "labels")
    hot = materialise(hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "hot-groups")
    hubs = hot.where("node = hub").select(key, F.col("label").alias("hub_label"))
    rest = materialise(join_skewed(hot, hubs, [key]).where("label <> hub_label").select(key, "node"), "rest")
    if rest.isEmpty():
        return links, labels
    again = hot.join(rest.select(key).distinct(), key, "left_semi")
    more = run(materialise(_dealt_again(materialise(again.select(key, "node", "blocks"), "again"), rest, key), "pairs"), again.select(F.col("node").alias("key")).distinct())
    return links.unionByName(more), None


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members: doc_id, n, node; links: a, b between nodes; their components, if they are known).  Links connect exactly the nodes that chains of similar sets connect."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = materialise(rows.mapInArrow(_based, "doc_id long, n long, node long"), "members")
    loud = rows.mapInArrow(_sketched, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 16")
    frequent = np.zeros(SKETCH, bool)
    frequent[loud.select("key").toArrow().column("key").to_numpy()] = True  # counters, of which there are SKETCH
    frequent = spark.sparkContext.broadcast(frequent)
    kind = "key long, node long, n int"
    counted = rows.mapInArrow(_keys(frequent, None), kind).groupBy("key").agg(F.count("*").alias("k"))
    repeated = materialise(counted.where("k > 1").select("key"), "repeated")
    keyed = materialise(rows.mapInArrow(_keys(frequent, key_filter(repeated)), kind), "keys")
    lists = keyed.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), *_list_digest("node")).where("lo < hi")
    chosen = lists.groupBy("sets", "s1", "s2", "lo", "hi").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    # a set's bitmap has at most half a byte for each of its shingles
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / (2 * BLOCK_BYTES)))).cast("long")
    chosen = materialise(chosen.select("key", blocks.alias("blocks"), F.col("lo").alias("hub")), "chosen")
    near = keyed.select("key", "node").mapInArrow(_filtered(key_filter(chosen)), "key long, node long")  # before the join shuffles it
    met = materialise(near.join(chosen, "key"), "met")
    discard(repeated, keyed, chosen)

    def fetched(form: Callable[[np.ndarray], bytes]) -> Callable[[DataFrame], DataFrame]:
        return lambda nodes: rows.mapInArrow(_fetched(key_filter(materialise(nodes.distinct(), "nodes")), form), "node long, n long, data binary").groupBy("node").agg(F.first("n").alias("n"), F.first("data").alias("data"))

    links, loose = _linked(met, "key", fetched(bitmap), ["key", "pair", "node", "n", "data", "side"], _loose)
    loose = materialise((components(links) if loose is None else loose).withColumnRenamed("label", "cluster"), "loose")
    discard(met)
    first = materialise(members.where("n > 0").groupBy("node").agg(F.first("n").alias("n")).join(loose, "node"), "clusters")
    sizes = first.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") * 8 / BLOCK_BYTES))).cast("long")
    sizes = sizes.select("cluster", blocks.alias("blocks"))
    index = materialise(join_skewed(first.select("cluster", "node"), sizes, ["cluster"]).withColumn("hub", F.col("cluster")), "index")
    links, labels = _linked(index, "cluster", fetched(_packed), ["cluster", "pair", "node", "data", "side"], _verified)
    return members, links, labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Sets are those of different 5-word shingles; a shorter text is one shingle, a text without words (or
    null) has none and is linked with nothing.  Rows with equal sets are always linked.  Repeated ids are
    rows of their own; other columns are ignored.  Sets are told apart by 64-bit digests of them.
    """
    members, links, labels = similar_sets(docs, id_col, text_col)
    labels = components(links) if labels is None else labels
    # one row a set first, pre-aggregated where the rows lie: a set with many copies is one row a task
    sets = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(labels, "node", "left")
    sets = materialise(sets.select("node", "doc_id", F.coalesce("label", F.col("node")).alias("label")), "sets")
    least = sets.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    nodes = materialise(join_skewed(sets, least, ["label"]).select("node", "component_id"), "components")
    found = join_skewed(members.where("n > 0"), nodes, ["node"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    discard(sets)
    return found.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in its own columns, without the rows whose component has a smaller id; rows that share the smallest id all stay."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, p, p + least(len(w), 5) - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
