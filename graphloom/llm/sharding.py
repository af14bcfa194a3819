"""Shards by a pseudorandom permutation of global row numbers: native DataFrame functions only.

A row's number in the order of ids goes through a Feistel network over pairs (left, right) with
left < a, right < b, where a * b is the least such product that holds all rows.  Numbers that fall outside the
table walk on along their cycle until they are inside.  So the shuffle is reproducible, and the shard and slot
of any row number (and the row number of any shard and slot) follow from the number of rows and the seed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import materialise, table
from graphloom.llm._rank import ranked
from graphloom.llm._sql import crc32

SHARDS = 16
SEED = 12
#: Half rounds of the network: each side is changed four times.
HALF_ROUNDS = 8
#: Steps of a cycle that an expression walks.  Less than a of the a * b numbers are outside, so tables of up to 63 * 63
#: rows never need more, and for others each step ends a walk with a probability of 1 - 1 / a; a longer walk raises an error.
WALK = 64


def sides(rows: int) -> tuple[int, int]:
    """a and b of the pairs that rows are numbered by."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _mixed(seed: int, k: Column, x: Column) -> Column:
    """A number below 2^48 from a half round and one side."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), x.cast("string"))), 1, 12), 16, 10).cast("long")


def _network(value: Column, rows: int, seed: int, backward: bool) -> Column:
    a, b = sides(rows)
    halves = range(HALF_ROUNDS)[::-1] if backward else range(HALF_ROUNDS)

    def half(s: Column, k: Column) -> Column:
        sign = F.lit(-1 if backward else 1)
        left, right = s["l"], s["r"]
        return F.when(
            k % 2 == 0, F.struct(F.pmod(left + sign * F.pmod(_mixed(seed, k, right), F.lit(a)), F.lit(a)).cast("long").alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), F.pmod(right + sign * F.pmod(_mixed(seed, k, left), F.lit(b)), F.lit(b)).cast("long").alias("r")))

    start = F.struct(F.call_function("div", value, F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.array(*map(F.lit, halves)), start, half, lambda s: s["l"] * F.lit(b) + s["r"])


def _walked(value: Column, rows: int, seed: int, backward: bool) -> Column:
    once = _network(value, rows, seed, backward)
    step = lambda v, _: F.when(v < rows, v).otherwise(_network(v, rows, seed, backward))
    lost = F.raise_error(F.lit("a cycle is longer than the walk; choose another seed")).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, step, lambda v: F.when(v < rows, v).otherwise(lost))


def permuted(number: Column, rows: int, seed: int = SEED) -> Column:
    """The place (below rows) that a row number (below rows) gets; different numbers get different places."""
    return _walked(number, rows, seed, False)


def restored(place: Column, rows: int, seed: int = SEED) -> Column:
    """The row number that got a place."""
    return _walked(place, rows, seed, True)


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot: rows are dealt to shards in a random order, so their counts differ by one at most.

    row is the number in the order of id, then text (by size, checksum and hash), from 0; null ids come
    first.  Rows equal in all of these take neighbouring numbers, in any order.  size is the text's bytes in UTF-8
    plus 1; a null text has none of its own and the checksum of an empty one.  Other columns are ignored.
    """
    text = docs[text_col].cast("string")
    facts = docs.select(
        docs[id_col].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("_hash"), F.lit(0).alias("_all"),
    )
    facts = materialise(facts, "sizes")
    rows = facts.count()
    numbered = ranked(facts, "_all", ["doc_id", "size", "text_crc32", "_hash"], ["doc_id", "size", "text_crc32"], "numbered")
    placed = numbered.withColumn("_place", permuted(F.col("pos"), rows, seed) if rows else F.col("pos"))
    return placed.select("doc_id", "size", "text_crc32", F.col("pos").alias("row"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.call_function("div", F.col("_place"), F.lit(shards)).cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard (shard=0, ...), its rows in files in the order of their slots; large shards have several files."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in 16 shards of equal counts."""
    found = assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    """DuckDB SQL of the query: the network as nested selects, the walk as a recursion."""
    mixed = lambda k, x: f"CAST('0x' || substr(md5('{SEED}:{k}:' || {x}), 1, 12) AS BIGINT)"
    out = "SELECT *, v // b AS l, v % b AS r FROM {source}"
    for k in range(HALF_ROUNDS):
        changed = f"(l + {mixed(k, 'r')} % a) % a AS l" if k % 2 == 0 else f"(r + {mixed(k, 'l')} % b) % b AS r"
        out = f"SELECT * REPLACE ({changed}) FROM ({out})"
    through = lambda source: f"SELECT i, n, a, b, l * b + r AS v FROM ({out.format(source=source)})"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32("coalesce(text, '')")} AS c, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM documents),
s AS (SELECT *, (n + a - 1) // a AS b FROM (SELECT i, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, i AS v FROM d)),
w AS ({through("s")} UNION ALL {through("(SELECT * FROM w WHERE v >= n)")})
SELECT doc_id, CAST(size AS BIGINT) AS size, c AS text_crc32, 'rows' AS law, CAST(v % {SHARDS} AS INTEGER) AS shard, v // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM d JOIN w ON w.i = d.i AND v < w.n"""


OP12_SQL = _oracle()
