"""Merkle manifest, sharding and periodic runs against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle, runs, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of an input.
CLASHING = ["tree", "pos", "members", "rest", "digest", "block", "size", "_row", "_part", "_own", "shard", "slot", "runs", "collapsed", "_text", "_all", "proof", "leaf"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def saved(spark, tmp_path, rows, schema=SCHEMA, **more):
    """A table folder with these documents, beside extra columns with clashing names if asked for."""
    df = spark.createDataFrame(rows, schema)
    df.select("*", *[F.lit(v).alias(k) for k, v in more.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])])


def brute_tree(nodes):
    """root and, by node, its siblings by level as (left, right)."""
    proofs, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, owned = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for leaf in owners[a + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(H(*run))
            owned.append(sum(owners[a : a + 16], []))
        nodes, owners = above, owned
    return nodes[0], proofs


def brute_manifest(rows):
    """Per row (in the order of sources, ids and leaves): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((order(r["doc_id"]), brute_leaf(r), r))
    sources = sorted(groups, key=order)
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda x: x[:2])
        trees[s] = brute_tree([x[1] for x in groups[s]])
    root, tops = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, leaf, r), proof in zip(groups[s], trees[s][1], strict=True):
            changed = r
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                changed = r | {"text": r["text"].translate(UPPER)}
            now = brute_leaf(changed)
            for left, right in proof + top:
                now = H(left, now, right)
            out.append((r["doc_id"], leaf, trees[s][0], root, H(*[a + b for a, b in proof + top]), now, now == root))
    return out


def odd_rows(n=120, seed=4):
    """Null ids, sources and texts, repeated rows, ids with several texts, one hot source."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "Small Text", "é" * (k % 5), "Same Same same"])
        rows.append({"doc_id": rng.choice([k, k, k, 7, None]), "text": text, "lang": rng.choice(["en", None]), "source": rng.choice(["hot"] * 5 + [None, "", "n", "é", f"s{k % 20}"]), "n_chars": rng.choice([None, k])})
    return rows + rows[:9] * 2


def as_tuples(rows):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [1, 16, 17, 120])
def test_manifest(spark, tmp_path, n):
    rows = odd_rows(n)
    folder = saved(spark, tmp_path, as_tuples(rows), **({c: 5 for c in CLASHING} if n == 120 else {}))
    got = merkle.op11_merkle_manifest(spark, folder).select(*MERKLE).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(rows)))
    assert {r["verified"] for r in got} >= ({True, False} if n == 120 else set())


def test_manifest_of_several_rounds(spark, tmp_path):
    rows = [{"doc_id": k, "text": f"T{k}", "lang": "en", "source": "hot" if k % 9 else f"s{k % 300}", "n_chars": k} for k in range(9000)]
    got = merkle.op11_merkle_manifest(spark, saved(spark, tmp_path, as_tuples(rows))).select(*MERKLE).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(rows)))


def test_manifest_of_nothing(spark, tmp_path):
    assert merkle.op11_merkle_manifest(spark, saved(spark, tmp_path, [])).collect() == []


def test_proofs_hold_for_stored_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", f"s{k % 3}", k) for k in range(40)], SCHEMA)
    proofs = merkle.manifest(merkle.document_leaves(docs))
    now = docs.withColumn("text", F.when(F.col("doc_id") == 11, "other").otherwise(F.col("text"))).union(spark.createDataFrame([(99, "new", "en", "s0", 3)], SCHEMA))
    assert {r["doc_id"]: r["verified"] for r in merkle.verified(now, proofs).collect()} == {k: k != 11 for k in range(40)} | {99: None}


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 100, 129])
def test_shards(spark, tmp_path, n):
    rows = odd_rows(n)
    folder = saved(spark, tmp_path, as_tuples(rows), **({c: 5 for c in CLASHING} if n == 129 else {}))
    got = sharding.op12_sharding(spark, folder).collect()
    facts = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows]
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(map(repr, facts))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    shards = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    sizes = list(map(len, shards.values()))
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    again = sharding.op12_sharding(spark, folder).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sharding.write_shards(sharding.assign_shards(spark.read.parquet(f"{folder}/documents.parquet")), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_shards_of_nothing(spark, tmp_path):
    assert sharding.op12_sharding(spark, saved(spark, tmp_path, [])).collect() == []


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 63, 64, 65, 1000, 4099])
def test_permutation(spark, rows):
    found = spark.range(rows).select("id", sharding.permuted(F.col("id"), rows, 5).alias("place")).withColumn("back", sharding.restored(F.col("place"), rows, 5)).collect()
    assert sorted(r["place"] for r in found) == list(range(rows))
    assert all(r["back"] == r["id"] for r in found)
    if rows >= 1000:
        places = [r["place"] for r in sorted(found)]
        assert abs(np.corrcoef(range(rows), places)[0, 1]) < 0.1 and len({b - a for a, b in zip(places, places[1:])}) > rows / 3
        assert places != [r["place"] for r in spark.range(rows).select("id", sharding.permuted(F.col("id"), rows, 6).alias("place")).sort("id").collect()]


def test_permutation_of_many_rows(spark):
    rows = 10**12 + 7
    found = spark.range(rows - 2000, rows).select("id", sharding.permuted(F.col("id"), rows).alias("place")).withColumn("back", sharding.restored(F.col("place"), rows)).collect()
    assert all(0 <= r["place"] < rows and r["back"] == r["id"] for r in found) and len({r["place"] for r in found}) == 2000


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any((i, length) == k and q % p == 0 for k, p in found.items()):
                found[(i, length)] = q
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def brute_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *top, H(lines), H(" ".join(w for k, w in enumerate(words) if k not in gone)))


def periodic_texts():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a", "x " + "a b c " * 9 + "a y", "é  é  " * 20, "one\x0btwo\x0c" * 30]
    for _ in range(110):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(0, 3)):
            a, q = rng.randrange(len(words)), rng.randint(1, 20)
            for i in range(a + q, min(len(words), a + q * rng.randint(3, 6) + rng.randint(0, q))):
                words[i] = words[i - q]
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    body = [str(rng.random()) for _ in range(700)]
    return [*texts, *texts[:30], " ".join(body * 4), " ".join(body + ["same"] * 4000), "a" * 50_000]


def test_periodic_runs(spark, tmp_path):
    texts = periodic_texts()
    ids = [*range(len(texts) - 9), *range(4), *[None] * 5]
    folder = saved(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], **{c: "z" for c in CLASHING})
    got = runs.op13_periodic_runs(spark, folder).collect()
    want = [brute_periodic(i, t) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r["n_runs"] > 0 for r in got) > 30


def test_periodic_runs_of_nothing(spark, tmp_path):
    assert runs.op13_periodic_runs(spark, saved(spark, tmp_path, [])).collect() == []


def test_collapsed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 20 + "y", "keep"), (2, "as  it is", "keep"), (3, None, None)], "id long, text string, collapsed string")
    got = sorted(map(tuple, runs.collapse_runs(docs).select(*docs.columns).collect()))
    assert got == [(1, "x a b y", "keep"), (2, "as  it is", "keep"), (3, None, None)]


def test_words_alone_give_the_same_runs():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(24, 90))]
        parts = runs.stretches(np.array(s))
        plain = sorted(((lo + a, n, p) for lo, hi in parts for a, n, p in runs._lyndon_runs(s[lo:hi], *runs._by_words(s[lo:hi]))), key=lambda r: (r[0], r[2]))
        assert plain == runs.word_runs(np.array(s)) == sorted(brute_runs(s), key=lambda r: (r[0], r[2]))
