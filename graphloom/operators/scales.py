"""Graphs of several scales: edge gates that know coarse nodes and links between scales, and books folded over chapters and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import gate_factor
from graphloom.sources.scratch import cut
from graphloom.sources.tables import slot_words, table, triples

#: Relations that link scales.
BETWEEN_SCALES = ("INTER_SCALE_PARENT", "INTER_SCALE_CHILD", "CONCEPT_ANCHOR", "COARSE_CONCEPT", "PART_OF_MACRO")


def scale_gated(edges: DataFrame, nodes: DataFrame, weights: dict[str, float], default: float = 0.9, *, between: float | None = None, coarse: float | None = None, positive: bool = True) -> DataFrame:
    """src, rel, dst, weight: the weight of each edge behind its gates (6 digits).

    edges: src, rel, dst, and truth and confidence of the edge itself (null: none); nodes: node, truth, confidence, coarse.
    The relation's weight (between, if given, for relations between scales) is multiplied by the gates of the edge
    and of its target, and once by `coarse`, if given, where an end is coarse.  Edges out of contradictions weigh 0.  Ends
    that no node describes have no gate.
    """
    base = F.lit(default)
    for rel, w in weights.items():
        base = F.when(F.col("rel") == rel, w).otherwise(base)
    if between is not None:
        base = F.when(F.col("rel").isin(*BETWEEN_SCALES), between).otherwise(base)
    end = lambda name: nodes.select(F.col("node").alias(name), F.struct("truth", "confidence", F.coalesce("coarse", F.lit(False)).alias("coarse")).alias(f"_{name}"))
    joined = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    gate = lambda truth, confidence: F.when(truth.isNull(), 1.0).otherwise(gate_factor(truth, F.coalesce(confidence, F.lit(1.0)), positive))
    refused = F.coalesce(F.col("_src.truth") == "CONTRADICTION", F.lit(False))
    damping = F.when(F.coalesce(F.col("_src.coarse"), F.lit(False)) | F.coalesce(F.col("_dst.coarse"), F.lit(False)), F.lit(1.0 if coarse is None else coarse)).otherwise(1.0)
    weight = base * gate(F.col("truth"), F.col("confidence")) * gate(F.col("_dst.truth"), F.col("_dst.confidence")) * damping
    return joined.select("src", "rel", "dst", F.when(refused, 0.0).otherwise(F.round(weight, 6)).alias("weight"))


def _fold(members: DataFrame, keys: list[str], words: int) -> DataFrame:
    """keys, cid, vec, members of groups of members (keys, node, cid, vec): the id covers the sorted names and ids of all members, the vector joins theirs."""
    rows = F.array_sort(F.collect_list(F.concat_ws("=", "node", "cid")))
    joined = F.array(*[F.bit_or(F.coalesce(F.get("vec", F.lit(k)), F.lit(0))) for k in range(words)])
    return members.groupBy(*keys).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("cid"), joined.alias("vec"), F.count("*").alias("members"))


def leaf_ids(leaves: DataFrame) -> DataFrame:
    """leaves with cid: the digest of each one's content."""
    return leaves.withColumn("cid", F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256))


def folded_book(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """level, path, node, cid, vec, members: the folds of every level, from the narrowest group (the last of levels) to the whole.

    leaves: the columns named in levels (from the widest group on), node, content and vec (array of 64-bit words).  A group is folded of the
    folds below it, so its id covers all content under it; groups are shuffled, texts aren't (leaves are digested where they lie).
    path holds the names of the groups around a fold and its own.
    """
    now = leaf_ids(leaves).select(*levels, F.col("node").cast("string").alias("node"), "cid", "vec")
    words = now.agg(F.max(F.size("vec"))).first()[0] or 0
    out = None
    for depth in range(len(levels), 0, -1):
        keys = levels[:depth]
        folds = cut(_fold(now, keys, words), f"fold-{levels[depth - 1]}")
        part = folds.select(F.lit(levels[depth - 1]).alias("level"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("path"), F.col(keys[-1]).cast("string").alias("node"), "cid", "vec", "members")
        out = part if out is None else out.unionByName(part)
        now = folds.select(*keys[:-1], F.col(keys[-1]).cast("string").alias("node"), "cid", "vec")
    return out


def verified_book(folds: DataFrame, leaves: DataFrame, levels: list[str]) -> DataFrame:
    """level, path, sound: whether each stored fold is still what its leaves, as they are now, give; groups that are gone or new are unsound."""
    again = folded_book(leaves, levels).select("level", "path", F.col("cid").alias("now"))
    return folds.select("level", "path", "cid").join(again, ["level", "path"], "full").select("level", "path", F.coalesce(F.col("cid") == F.col("now"), F.lit(False)).alias("sound"))


def unfolded_group(leaves: DataFrame, levels: list[str], path: Column | str) -> DataFrame:
    """The leaves under a fold, told by its path at any level."""
    parts = F.array(*[F.col(k).cast("string") for k in levels])
    wanted = F.split(F.lit(path) if isinstance(path, str) else path, "/")
    return leaves.where(F.slice(parts, F.lit(1), F.size(wanted)) == wanted)


def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to nations to regions: nations are coarse, links to regions run between scales, some edges have a status of their own."""
    t = triples(spark, sf_dir).where("property IN ('NATION', 'REGION')").select(F.col("subject").alias("src"), F.when(F.col("property") == "REGION", "PART_OF_MACRO").otherwise(F.col("property")).alias("rel"), F.col("object").alias("dst"))
    k = F.length("src") + F.length("dst")
    edges = t.withColumns({"truth": F.when(k % 4 == 0, "UNKNOWN").when(k % 7 == 0, "FALSE"), "confidence": F.when(k % 4 == 0, 0.5)})
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.when(F.col("c_custkey") % 9 == 0, "CONTRADICTION").otherwise("TRUE").alias("truth"), F.lit(1.0).alias("confidence"), F.lit(None).cast("boolean").alias("coarse"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 5 == 0, "UNKNOWN").otherwise("TRUE").alias("truth"), F.lit(0.4).alias("confidence"), F.lit(True).alias("coarse"))
    return scale_gated(edges, c.unionByName(n), {"NATION": 0.8}, between=0.6, coarse=0.5)


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = slot_words(spark, sf_dir)
    return e.select((F.col("id") % 2).alias("book"), (F.col("id") % 10).alias("chapter"), (F.col("id") % 50).alias("chunk"), F.col("id").alias("node"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"), F.col("words").alias("vec"))


def q_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in chunks, chapters and books: ids, joined first words, and which folds hold after the content of some changed."""
    leaves, levels = _book(spark, sf_dir), ["book", "chapter", "chunk"]
    folds = cut(folded_book(leaves, levels), "book")
    changed = leaves.withColumn("content", F.when(F.col("node").isin(7, 14), F.lit("spoilt")).otherwise(F.col("content")))
    return folds.join(verified_book(folds, changed, levels), ["level", "path"]).select("level", "path", "cid", F.get("vec", F.lit(0)).alias("word"), "members", "sound")


QUERIES = {"edge_gate_scales": q_gate, "book_folds": q_book}
_BITS = "list_sum(list_transform(range(32), lambda j: CAST(CASE WHEN e[j + 1] >= 0.1 THEN 1 WHEN e[j + 1] <= -0.1 THEN 2 WHEN abs(e[j + 1]) >= 0.05 THEN 3 ELSE 0 END AS HUGEINT) * CAST(pow(2, 2 * j) AS HUGEINT)))"
ORACLE_SQL = {
    "edge_gate_scales": """WITH t AS (SELECT 'C:' || c_custkey AS src, 'NATION' AS rel, 'N:' || c_nationkey AS dst, c_custkey % 9 = 0 AS refused, true AS damped, c_nationkey % 5 = 0 AS open FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'NATION', 'N:' || s_nationkey, false, true, s_nationkey % 5 = 0 FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'PART_OF_MACRO', 'R:' || n_regionkey, false, true, false FROM nation)
SELECT src, rel, dst, CAST(CASE WHEN refused THEN 0.0 ELSE round(CASE WHEN rel = 'NATION' THEN 0.8 ELSE 0.6 END * CASE WHEN (length(src) + length(dst)) % 4 = 0 THEN 0.5 WHEN (length(src) + length(dst)) % 7 = 0 THEN 0.0 ELSE 1.0 END * CASE WHEN open THEN 0.4 ELSE 1.0 END * 0.5, 6) END AS DOUBLE) AS weight FROM t""",
    "book_folds": f"""WITH l AS (SELECT vec_id AS id, vec_id % 2 AS b, vec_id % 10 AS c, vec_id % 50 AS k, sha256('text ' || vec_id) AS cid, {_BITS} AS w FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)), s AS (SELECT *, CAST(w - CASE WHEN w >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS word FROM l),
f3 AS (SELECT b, c, k, sha256(string_agg(id || '=' || cid, chr(10) ORDER BY id || '=' || cid)) AS cid, bit_or(word) AS word, count(*) AS members FROM s GROUP BY ALL), f2 AS (SELECT b, c, sha256(string_agg(k || '=' || cid, chr(10) ORDER BY k || '=' || cid)) AS cid, bit_or(word) AS word, count(*) AS members FROM f3 GROUP BY b, c), f1 AS (SELECT b, sha256(string_agg(c || '=' || cid, chr(10) ORDER BY c || '=' || cid)) AS cid, bit_or(word) AS word, count(*) AS members FROM f2 GROUP BY b)
SELECT 'chunk' AS level, b || '/' || c || '/' || k AS path, cid, word, members, k NOT IN (7, 14) AS sound FROM f3 UNION ALL SELECT 'chapter', b || '/' || c, cid, word, members, c NOT IN (7, 4) FROM f2 UNION ALL SELECT 'book', CAST(b AS VARCHAR), cid, word, members, false FROM f1""",
}
