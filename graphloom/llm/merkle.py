"""A Merkle manifest of a dataset: sources are trees of 16 children, their roots the leaves of one more tree.

Leaves are placed in their source's order and cut into aligned blocks of 16^3.  A task walks a block in
postorder: it returns the digest of each subtree and, as it unwinds, appends to every leaf below what stood to
the left and to the right.  The blocks' roots are the leaves of the next round, until each source has one; the roots of the
sources go the same way.  Proofs are then handed down: a block is walked once more with the proof of its root, which
every leaf's own proof is extended by.  Only digests are shuffled, and no group holds more than 16^3 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import materialise, table
from graphloom.llm._rank import ranked
from graphloom.llm._sql import crc32

#: Children of a node.
FAN = 16
#: Levels that one task walks.
DEPTH = 3
BLOCK = FAN**DEPTH

Proof = list[tuple[str, str]]
_PROOF = "array<struct<left: string, right: string>>"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The digest of a row: each column as -, or as its UTF-8 length, a colon and its value."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a digest leads to by a proof: of each level's left siblings, itself and right siblings."""
    return F.aggregate(proof, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def walk(digests: list[str], levels: int, emit: Callable[[int, Proof], None] | None = None) -> str:
    """The digest of a tree of so many levels over digests, in postorder; emit gets each leaf's number and its siblings by level from below."""
    proofs: list[Proof] = [[] for _ in digests] if emit else []

    def subtree(lo: int, hi: int, level: int) -> str:
        if level == 0:
            return digests[lo]
        width = FAN ** (level - 1)
        starts = range(lo, hi, width)
        children = [subtree(a, min(a + width, hi), level - 1) for a in starts]
        if emit:
            for k, a in enumerate(starts):
                siblings = "".join(children[:k]), "".join(children[k + 1 :])
                for i in range(a, min(a + width, hi)):
                    proofs[i].append(siblings)
        return hashlib.sha256("".join(children).encode()).hexdigest()

    root = subtree(0, len(digests), levels)
    if emit:
        for i, p in enumerate(proofs):
            emit(i, p)
    return root


def _levels(size: int) -> int:
    """Levels to walk in a block of a row of so many nodes: all of DEPTH if there are more blocks, else until one node remains."""
    levels = 0
    while levels < DEPTH and FAN**levels < size:
        levels += 1
    return levels


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def _roots(rows: pa.Table) -> pa.Table:
    rows = _in_order(rows)
    size = rows.column("members")[0].as_py()
    root = walk(rows.column("digest").to_pylist(), _levels(size))
    return pa.table({"tree": rows.column("tree")[:1], "pos": pa.array([rows.column("block")[0].as_py()], pa.int64()), "members": pa.array([-(-size // BLOCK)], pa.int64()), "digest": pa.array([root], pa.string())})


def _extended(rows: pa.Table, upper: pa.Table) -> pa.Table:
    """The rows of a block with their proofs, each extended by the one of the block's root."""
    rows = _in_order(rows)
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    above = [(s["left"], s["right"]) for s in upper.column("proof")[0].as_py()] if len(upper) else []
    proofs: list[Proof] = []
    walk(rows.column("digest").to_pylist(), _levels(rows.column("members")[0].as_py()), lambda _, p: proofs.append(p + above))
    return pa.table({"rest": rows.column("rest"), "tree": rows.column("tree"), "pos": rows.column("pos"), "digest": rows.column("digest"), "proof": pa.array([[{"left": a, "right": b} for a, b in p] for p in proofs], kind)})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def _block_roots(nodes: DataFrame) -> DataFrame:
    rows = _blocked(nodes.select("tree", "pos", "members", "digest"))
    return rows.groupBy("tree", "block").applyInArrow(_roots, "tree string, pos long, members long, digest string")


def _with_upper(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """nodes (rest, tree, pos, members, digest) with proof; upper: tree, block, proof of each block's root."""
    kind = nodes.schema["rest"].dataType.simpleString()
    left = _blocked(nodes).groupBy("tree", "block")
    return left.cogroup(upper.groupBy("tree", "block")).applyInArrow(_extended, f"rest {kind}, tree string, pos long, digest string, proof {_PROOF}")


def forest(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of all trees over nodes (tree, pos, members, digest), each written, from below; and each tree's root: tree, digest.

    A round is a 4,096th of the one before, so there are few: three for 10^11 leaves.
    """
    rounds = [materialise(_block_roots(nodes), f"{name}-roots")]
    while not rounds[-1].where("members > 1").isEmpty():
        rounds.append(materialise(_block_roots(rounds[-1]), f"{name}-roots"))
    return rounds, rounds[-1].select("tree", "digest")


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf and others) with subroot, root and proof (array of left, right: siblings by level up to the root).

    leaves should be a written table.  The leaves of a source ascend by doc_id (null first), then by digest; sources by
    their bytes (null first, a source of its own).  Rows equal in source, id and digest take neighbouring
    places, in any order.  A table without rows has no root and gives no rows.
    """
    rest = [c for c in leaves.columns if c != "leaf"]
    keyed = leaves.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("tree"), F.col("doc_id").alias("_id"), F.struct(*[F.col(c) for c in rest]).alias("rest"), F.col("leaf").alias("digest"))
    nodes = materialise(ranked(keyed, "tree", ["_id", "digest"], ["rest", "digest"], "leaves"), "leaves")
    rounds, subroots = forest(nodes, "source")
    subroots = materialise(subroots, "subroots")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_tree"), "digest")
    tops = materialise(ranked(tops, "tree", ["_tree"], ["_tree", "digest"], "sources").withColumn("rest", F.struct(F.col("_tree"))).drop("_tree"), "sources")
    top_rounds, roots = forest(tops, "dataset")
    no_proof = lambda below: below.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(_PROOF).alias("proof"))

    def handed_down(lowest: DataFrame, rounds: list[DataFrame], upper: DataFrame, name: str) -> DataFrame:
        """Proofs of the lowest nodes: round by round from the roots (upper: their proofs) down."""
        for nodes in reversed(rounds[:-1]):
            found = _with_upper(nodes.withColumn("rest", F.struct("pos")), upper)
            upper = materialise(found.select("tree", F.col("pos").alias("block"), "proof"), f"{name}-proofs")
        return _with_upper(lowest, upper)

    root = roots.first()
    sources = handed_down(tops, top_rounds, no_proof(roots), "dataset")
    upper = materialise(sources.select(F.col("rest._tree").alias("tree"), F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("block"), "proof"), "subroot-proofs")
    below = handed_down(nodes, rounds, upper.select("tree", "block", "proof"), "source")
    whole = below.join(upper.select("tree", "subroot"), "tree")
    return whole.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")


#: Fixed: the columns of a document's digest.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, source, leaf and what else is asked for, written; other columns of docs are ignored."""
    found = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), leaf(*[docs[c] for c in LEAF_COLUMNS]).alias("leaf"), *[c.alias(k) for k, c in more.items()])
    return materialise(found, "leaves")


def verified(docs: DataFrame, proofs: DataFrame, on: str = "doc_id") -> DataFrame:
    """doc_id, verified: whether the rows of docs, as they are now, lead to the root by the proofs of a manifest; null where there is no proof.  Ids must be unique."""
    now = docs.select(docs[on].alias("doc_id"), leaf(*[docs[c] for c in LEAF_COLUMNS]).alias("_leaf"))
    held = proofs.select(F.col(on).alias("doc_id"), "proof", "root")
    return now.join(held, "doc_id", "left").select("doc_id", (folded(F.col("_leaf"), F.col("proof")) == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: leaf, roots and proof of every document, and whether each verifies after a fifth of the texts were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate(docs["text"], ascii_uppercase, ascii_lowercase)
    tampered = F.when(F.crc32(docs["doc_id"].cast("string")) % 5 == 0, leaf(*[docs[c] for c in LEAF_COLUMNS[:-1]], lowered))
    found = manifest(document_leaves(docs, tampered=tampered))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 4, top_levels: int = 2) -> str:
    """DuckDB SQL of the query for tables of at most 16^levels rows a source and 16^top_levels sources."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: f"sha256({' || '.join(field(c) for c in LEAF_COLUMNS[:-1])} || {field(text)})"
    lowered = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    parts = [f"d AS (SELECT doc_id, coalesce('s' || source, 'n') AS k, {digest('text')} AS h, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {digest(lowered)} ELSE {digest('text')} END AS t FROM documents)"]

    def tree(name: str, leaves: str, depth: int) -> None:
        parts.append(f"{name}0 AS ({leaves})")
        for j in range(depth):
            parts.append(f"{name}{j + 1} AS (SELECT k, i // {FAN} AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, CASE WHEN n > 1 THEN (n + {FAN - 1}) // {FAN} ELSE 1 END AS n FROM {name}{j} GROUP BY k, i // {FAN}, n)")
            parts.append(f"{name}p{j} AS (SELECT a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{j} a JOIN {name}{j} b ON a.k = b.k AND a.i // {FAN} = b.i // {FAN} WHERE a.n > 1 GROUP BY a.k, a.i)")

    numbers = "row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n"
    parts.append(f"e AS (SELECT *, {numbers.format(by='k', order='doc_id NULLS FIRST, h')} FROM d)")
    tree("s", "SELECT k, i, h, n FROM e", levels)
    parts.append(f"subroots AS (SELECT k AS source_key, h, {numbers.format(by="''", order='k')} FROM s{levels})")
    tree("t", "SELECT '' AS k, i, h, n FROM subroots", top_levels)
    parts.append("f0 AS (SELECT e.*, u.h AS subroot, u.i AS top, t AS f, '' AS proof FROM e JOIN subroots u ON u.source_key = e.k)")
    steps = [(f"sp{j}", "e.k", f"e.i // {FAN**j}") for j in range(levels)] + [(f"tp{j}", "''", f"e.top // {FAN**j}") for j in range(top_levels)]
    for j, (name, key, place) in enumerate(steps):
        parts.append(f"f{j + 1} AS (SELECT e.* REPLACE (CASE WHEN p.l IS NULL THEN f ELSE sha256(p.l || f || p.r) END AS f, e.proof || coalesce(p.l || p.r, '') AS proof) FROM f{j} e LEFT JOIN {name} p ON p.k = {key} AND p.i = {place})")
    root = f"(SELECT h FROM t{top_levels})"
    return f"WITH {', '.join(parts)} SELECT doc_id, h AS leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = {root} AS verified FROM f{len(steps)}"


OP11_SQL = _oracle()
