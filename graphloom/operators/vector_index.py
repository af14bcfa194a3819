"""An inverted-file index over vectors: each row is stored under the nearest of a few centroids, its cell.

Centroids are fitted on a bounded sample; every row is assigned and stored, one folder a cell, so a search reads the
cells that it asks for and no others.  With `probes` a query asks for its nearest cells (some rows may be missed);
without, for every cell that can hold a row of the wanted cosine: no member of a cell is further from its centroid than
the widest angle that was stored with it, so nothing is missed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.retrieval import ROWS_AT_ONCE, keep_best, top_k
from graphloom.sources.scratch import scratch_dir
from graphloom.sources.tables import table

#: Rows that centroids are fitted on at most (chosen by a hash of their key), and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of a cell that one task writes, about.
CELL_FILE_ROWS = 1_000_000
#: Queries that a pass over the cells takes along at most.
QUERIES_AT_ONCE = 4096


@dataclass(frozen=True)
class VectorIndex:
    """path: folder with `rows` (key, v of length 1, cell) and `cells`; centroids: one row a cell; reach: widest angle of each cell's members."""

    path: str
    key: str
    cells: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def fit_centroids(vectors: DataFrame, cells: int, *, key: str = "vec_id", sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Directions of about `cells` groups of the vectors (key, v), by spherical k-means on at most `sample` of them."""
    chosen = vectors.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).select("v").toArrow().column("v").combine_chunks()
    if not len(chosen):
        return np.zeros((0, 0))
    points = _unit(_matrix(chosen, len(chosen.flatten()) // len(chosen)))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        empty = ~np.bincount(nearest, minlength=len(centres)).astype(bool)
        sums[empty] = points[rng.choice(len(points), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def build_index(vectors: DataFrame, path: str, cells: int, *, key: str = "vec_id", sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
    """Assign every vector (key long, v: array of numbers, all of one length) to its cell and write the index to path.

    Rows whose v is null are left out; a vector of zeros is kept, with a cosine of 0 to everything.  Repeated
    keys are rows of their own; other columns are ignored.  Large cells are written by several tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("v").isNotNull()).select(F.col(key).cast("long").alias(key), F.transform("v", lambda x: x.cast("double")).alias("v"))
    centroids = spark.sparkContext.broadcast(fit_centroids(rows, cells, key=key, sample=sample, seed=seed))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _unit(_matrix(batch.column(1), centroids.value.shape[1]))
                near = points @ centroids.value.T
                cell = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1]), pa.array(points.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(cell.astype(np.int32)), pa.array(angle)], [key, "v", "cell", "angle"])

    assigned = rows.mapInArrow(assign, f"{key} long, v array<double>, cell int, angle double")
    spread = 1 + rows.count() // CELL_FILE_ROWS
    assigned.repartition("cell", F.pmod(F.xxhash64(key), F.lit(spread))).write.partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(f"{key} long, v array<double>, angle double, cell int").parquet(f"{path}/rows")
    known = stored.groupBy("cell").agg(F.max("angle").alias("reach")).toPandas()  # a row for each cell
    lines = [(int(c), float(r), centroids.value[int(c)].tolist()) for c, r in zip(known["cell"], known["reach"], strict=True)]
    spark.createDataFrame(lines, "cell int, reach double, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path, key=key)


def open_index(spark: SparkSession, path: str, *, key: str = "vec_id") -> VectorIndex:
    """An index that was written before."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centroids = np.array([c["centroid"] for c in cells]) if cells else np.zeros((0, 0))
    return VectorIndex(path, key, np.array([c["cell"] for c in cells], int), centroids, np.array([c["reach"] for c in cells]))


def asked_cells(index: VectorIndex, queries: np.ndarray, threshold: float, probes: int | None) -> np.ndarray:
    """Which cells (columns) each query (rows, of length 1) asks for."""
    near = queries @ index.centroids.T
    if probes is not None:
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, order, True, axis=1)
        return out
    angle = np.arccos(np.clip(near, -1, 1))
    return angle - index.reach[None, :] <= np.arccos(np.clip(threshold - 1e-6, -1, 1)) + 1e-6


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, *, threshold: float = -1.0, k: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, key, score, rank: rows whose cosine (6 digits) to a query (query_id long, v) is threshold or more, the k best if k is given; ties by key.

    Without probes no row is missed.  The queries are a stated set: they go out in blocks of QUERIES_AT_ONCE,
    each a pass over the cells that it asks for.  With k a task keeps k rows a query.  Null query vectors find nothing.
    """
    asked = queries.where(F.col("v").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    schema = f"query_id long, {index.key} long, score double"
    out = spark.createDataFrame([], schema)
    blocks = 1 + asked.count() // QUERIES_AT_ONCE if len(index.cells) else 0
    for b in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if not block.num_rows:
            continue
        ids, matrix = block.column("query_id").to_numpy(), _unit(_matrix(block.column("v").combine_chunks(), index.centroids.shape[1]))
        wanted = asked_cells(index, matrix, threshold, probes)
        of = {int(c): np.flatnonzero(wanted[:, j]) for j, c in enumerate(index.cells) if wanted[:, j].any()}
        shared = spark.sparkContext.broadcast((ids, matrix, of))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, of = shared.value
            best, held = np.full((k or 0, len(ids)), -np.inf), np.zeros((k or 0, len(ids)), np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    keys, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    points = _matrix(batch.column(1), matrix.shape[1])
                    for cell in np.unique(cells):
                        rows, who = np.flatnonzero(cells == cell), of[int(cell)]
                        scores = np.round(points[rows] @ matrix[who].T, 6)
                        if k is None:
                            r, q = np.nonzero(scores >= threshold)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[who[q]]), pa.array(keys[rows[r]]), pa.array(scores[r, q])], ["query_id", index.key, "score"])
                            continue
                        scores[scores < threshold] = -np.inf
                        best[:, who], held[:, who] = keep_best(best[:, who], held[:, who], scores, keys[rows], k)
            if k is not None:
                r, q = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(held[r, q]), pa.array(best[r, q])], ["query_id", index.key, "score"])

        stored = spark.read.schema(f"{index.key} long, v array<double>, cell int").parquet(f"{index.path}/rows").where(F.col("cell").isin(list(of)))
        out = out.unionByName(stored.mapInArrow(run, schema))
    return top_k(out, k if k is not None else (1 << 31) - 1, key=index.key)


#: Cosine from which a function counts as found.
FUNCTION_THRESHOLD = 0.80


def search_functions(spark: SparkSession, index: VectorIndex, queries: DataFrame, threshold: float = FUNCTION_THRESHOLD, k: int | None = None) -> DataFrame:
    """Functions (rows of an index over their vectors) that descriptions (query_id, v) find: cosine of threshold or more, best first."""
    return search(spark, index, queries, threshold=threshold, k=k)


def rank_functions(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """The k functions nearest to each description, whatever their cosine."""
    return search(spark, index, queries, k=k)


def functions_by_name(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """name, node: the function definitions among nodes (node, kind, anchor) that are anchored as func:name, for every asked name."""
    named = nodes.where("kind = 'FunctionDef' AND startswith(anchor, 'func:')").select(F.expr("substring(anchor, 6)").alias("name"), "node")
    return asked.select("name").distinct().join(named, "name")


def archetypes(scores: DataFrame, k: int, threshold: float, mode: str = "scaled") -> DataFrame:
    """The k best archetypes of each term (term, archetype, score) above a threshold, with the slot value that they get.

    mode: true (1), unknown (3), or scaled: 1 from a cosine of 0.85 on, else 3.
    """
    value = {"true": F.lit(1), "unknown": F.lit(3), "scaled": F.when(F.col("score") >= 0.85, 1).otherwise(3)}[mode]
    return top_k(scores.where(F.col("score") >= threshold), k, group="term", key="archetype").select("term", "archetype", "score", "rank", value.alias("value"))


def described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries): every vector as that of a function, and for each whose id is divisible by 50 a description: twice its vector plus the next one's."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    asked = v.where("vec_id % 50 = 0").join(after, "vec_id").select(F.col("vec_id").alias("query_id"), F.zip_with("v", "w", lambda a, b: 2 * a + b).alias("v"))
    return v, asked


def _index(spark: SparkSession, vectors: DataFrame) -> VectorIndex:
    return build_index(vectors, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}", 16)


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that descriptions find, by the exact route of the index."""
    vectors, asked = described(spark, sf_dir)
    return search_functions(spark, _index(spark, vectors), asked).select("query_id", "vec_id", "score", "rank")


def q_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five functions nearest to each description."""
    vectors, asked = described(spark, sf_dir)
    return rank_functions(spark, _index(spark, vectors), asked, 5).select("query_id", "vec_id", "score", "rank")


def q_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions named after labels, asked for by name."""
    e = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 4 == 0, "Call").otherwise("FunctionDef")
    nodes = e.select(F.col("vec_id").alias("node"), kind.alias("kind"), F.concat(F.lit("func:f"), "label").alias("anchor"))
    return functions_by_name(nodes, e.where("label % 3 = 0").select(F.concat(F.lit("f"), "label").alias("name")))


def q_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions projected on all vectors as archetypes, in each mode."""
    vectors, asked = described(spark, sf_dir)
    scores = search(spark, _index(spark, vectors), asked, threshold=0.3).select(F.col("query_id").alias("term"), F.col("vec_id").alias("archetype"), "score")
    parts = [archetypes(scores, 3, 0.3, mode).withColumn("mode", F.lit(mode)) for mode in ("true", "unknown", "scaled")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"function_search": q_search, "function_rank": q_rank, "function_by_name": q_by_name, "archetype_modes": q_modes}
_PAIRS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.v, b.v), lambda p: 2 * p[1] + p[2]) AS v FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
p AS (SELECT query_id, CAST(vec_id AS BIGINT) AS vec_id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"""
ORACLE_SQL = {
    "function_search": f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM r WHERE score >= 0.8",
    "function_rank": f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5",
    "function_by_name": "SELECT 'f' || label AS name, vec_id AS node FROM embeddings WHERE label % 3 = 0 AND vec_id % 4 <> 0",
    "archetype_modes": f"WITH {_PAIRS} SELECT query_id AS term, vec_id AS archetype, score, rank, mode, CASE WHEN mode = 'true' OR mode = 'scaled' AND score >= 0.85 THEN 1 ELSE 3 END AS value FROM r, (SELECT unnest(['true', 'unknown', 'scaled']) AS mode) WHERE score >= 0.3 AND rank <= 3",
}
