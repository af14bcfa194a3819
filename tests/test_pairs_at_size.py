"""Pairs and searches whose cost must not follow the number of equal rows."""

import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import discourse, graph, memory, ranking, resolve, retrieval, spatial


def test_cues_have_words_of_ascii_letters(spark):
    """As in SQL, a letter with an accent is no part of a word."""
    texts = ["die ßbeen lichen", "été enbeen lichen", "vor zwei hoursäeventually", "it \x0bwas\x0bopened", "the ſeemſ is late, poſſibly", "be öffen", "was opened later"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = d.select("id", *[f.alias(n) for n, f in discourse.cue_flags(d["t"]).items()], discourse.has_cue(d["t"], discourse.GAPS).alias("gap")).orderBy("id").collect()
    con = duckdb.connect()
    for name, pattern in [*discourse.CUES.items(), ("gap", discourse.GAPS)]:
        assert [r[name] for r in rows] == [con.execute("SELECT regexp_matches(?, " + discourse._re(pattern) + ")", [t]).fetchone()[0] for t in texts], name
    assert rows[0].passive


def _rows(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("xy"), rng.choice(["ab cd", "ab ce", "b", "", None])) for k in range(300)]
    return rows, spark.createDataFrame(rows, "id long, block string, name string")


def test_kinds_are_scored_once(spark, monkeypatch):
    """Copies of names are paired without scoring them again, runs are cut, and nulls stay."""
    monkeypatch.setattr(resolve, "RUN", 7)
    rows, df = _rows(spark)
    seen = []

    def score(n):
        seen.append(n.count())
        return resolve.dice(n, "a_name", "b_name", ["a_name", "b_name"]).join(n.withColumn("distance", resolve.damerau("a_name", "b_name")), ["a_name", "b_name"], "right")

    got = {(r.a_id, r.b_id): r.distance for r in resolve.kind_pairs(df, ["block"], ["name"], score).collect()}
    want = {(i, j): None if a is None or b is None else resolve.transposition_distance(a, b) for i, x, a in rows for j, y, b in rows if x == y and i < j}
    assert got == want
    assert seen == [25]


def test_distances_are_made_for_many_pairs_at_once(monkeypatch):
    """Distances with swaps equal those of single pairs for short, long, empty and odd strings, in pieces and at once."""
    rng = random.Random(4)
    a, b = ([("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 13, size])))) for letters, size in (("abc", 30), ("aé😀\0", 99), ("ab", 130)) for _ in range(200)] for _ in "ab")
    want = [resolve.transposition_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert resolve.transposition_distances(a, b).tolist() == want
    monkeypatch.setattr(resolve, "CELLS", 50)
    assert resolve.transposition_distances(a, b).tolist() == want
    assert resolve.transposition_distances([], []).tolist() == []


def test_many_kinds_are_scored_where_they_meet(spark, monkeypatch):
    """With more kinds than a small table can hold, pairs are scored in their block and none is shuffled."""
    rows, df = _rows(spark)

    def score(n):
        return n.withColumns({"distance": resolve.damerau("a_name", "b_name"), "dice": resolve.dice_score(F.col("a_name"), F.col("b_name"))})

    many = spark.range(800).selectExpr("id", "'x' AS block", "concat('n', id) AS name")
    plan = resolve.kind_pairs(many, ["block"], ["name"], lambda n: n.withColumn("distance", resolve.damerau("a_name", "b_name")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a_name" not in plan
    few = resolve.kind_pairs(df, ["block"], ["name"], score)
    monkeypatch.setattr(resolve, "KINDS", 2)
    monkeypatch.setattr(resolve, "RUN", 7)

    def dice(x, y):
        g, h = (Counter(zip(s or "", (s or "")[1:])) for s in (x, y))
        return round(2 * (g & h).total() / (g.total() + h.total()), 6) if g or h else None if None in (x, y) else float(x == y)

    want = sorted((i, j, -1 if None in (x, y) else resolve.transposition_distance(x, y), -1.0 if (d := dice(x, y)) is None else d) for i, s, x in rows for j, t, y in rows if s == t and i < j)
    for got in (few, resolve.kind_pairs(df, ["block"], ["name"], score)):
        assert sorted(map(tuple, got.fillna(-1).collect())) == want


def test_blocks_meet_by_sorting(spark, tmp_path):
    """Runs of a block meet by sorting, so a table that is small on disk is not sent whole through the driver to every task."""
    df = spark.createDataFrame([(k, "xyz"[k % 3], f"n{k % 2}") for k in range(300)], "id long, block string, name string")
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    got = resolve.kind_pairs(spark.read.parquet(f"{tmp_path}/t"), ["block"], ["name"], lambda n: n.withColumn("same", F.col("a_name") == F.col("b_name")))
    assert got.count() == 3 * 100 * 99 // 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [block" in plan


def test_blocks_are_compared_without_their_pairs(spark):
    """The best of a block's pairs comes from its names, equal ones and repeated ids included."""
    rng = random.Random(5)
    rows = [(rng.randrange(150), f"{rng.choice('ab')} {rng.choice(['k', 'kk', 'mno'])} z") for _ in range(200)]
    df = spark.createDataFrame(rows, "id long, name string")
    plain = resolve.word_blocks(df).withColumn("s", resolve.levenshtein_similarity(F.col("a_name"), F.col("b_name")))
    want = plain.groupBy("a_id").agg(F.count("*").alias("pairs"), F.round(F.max("s"), 6).alias("best"))
    got = resolve.block_similarity(df)
    assert sorted(got.collect()) == sorted(want.collect())


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    """Boxes of a scene: corners are compared once for all boxes that have them."""
    rows = [(k, "s", float(k % 3), 0.0, k % 3 + 1.0, 1.0) for k in range(60)]
    boxes = spark.createDataFrame(rows, "id long, scene string, x1 double, y1 double, x2 double, y2 double")
    seen, plain = [], spatial.related
    monkeypatch.setattr(spatial, "boxes", lambda s, d: boxes)
    monkeypatch.setattr(spatial, "related", lambda p: seen.append(p.count()) or plain(p))
    got = spatial.q_relations(spark, "").collect()
    assert seen == [9]
    assert len(got) == 60 * 59 // 2
    assert {(r.a_id % 3, r.b_id % 3, r.relation) for r in got} == {(i, j, ("EQ", "EC", "DC")[abs(i - j)]) for i in range(3) for j in range(3)}


def test_best_concepts_equal_all_overlaps(spark, monkeypatch):
    """Listing the first units of each subset finds the best of all overlaps, for small and large sets and equal ones (F1)."""
    rng = random.Random(7)
    monkeypatch.setattr(ranking, "SUBSET_CODES", 4)
    units = spark.createDataFrame([(k, [rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 3, 4, 7]))]) for k in range(400)], "doc_id long, codes array<long>")
    asked = units.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    want = retrieval.top_k(ranking.concept_overlap(units, asked).where("query_id <> doc_id"), 5)
    assert sorted(ranking.best_by_concepts(units, asked, 5).collect()) == sorted(want.collect())


def test_best_rows_and_queries_of_blocks(spark):
    """k best both ways equal plain sorting, with equal scores, several blocks and pieces."""
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (1300, 4)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>").repartition(3)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    dots = lambda a, b: a @ b.T
    want, back = set(), set()
    for q in range(0, 1300, 50):
        near = sorted((-(m[k] @ m[q]), k) for k in range(1300) if k != q)[:6]
        want |= {(q, k, -s, i + 1) for i, (s, k) in enumerate(near)}
    for k in range(1300):
        back |= {(k, q, -s) for s, q in sorted((-(m[k] @ m[q]), q) for q in range(0, 1300, 50) if q != k)[:3]}
    assert {tuple(r) for r in retrieval.nearest(rows, asked, 6, dots, key="id", most=10).collect()} == want
    assert {tuple(r) for r in retrieval.best_queries(rows, asked, 3, dots, key="id", most=10).collect()} == back


def test_distances_are_counted_in_tasks(spark):
    """Counts of distances over prefixes equal those of all pairs (F8)."""
    rng = random.Random(9)
    m = [[rng.randrange(4) for _ in range(6)] for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(m)), "id long, v array<int>")
    got = memory.distance_counts(rows, rows.where("id % 7 = 0").withColumnRenamed("id", "query_id"), (2, 6))
    want = Counter((p, sum(x != y for x, y in zip(m[i][:p], m[q][:p], strict=True))) for p in (2, 6) for q in range(0, 120, 7) for i in range(120) if i != q)
    assert {(r.slots, r.d): r.n for r in got.collect()} == want


def test_bm25_shuffles_no_pairs(spark):
    """Scores of a document are summed where its postings lie, with hits and without; scaling needs no window."""
    docs = spark.createDataFrame([(k, f"word{k % 5} other{k % 3} " * (1 + k % 4)) for k in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word1 other2"), (2, "word4")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 0, 4.0, False), (3, 7, 8.0, True)], "query_id long, doc_id long, bonus double, exact boolean")
    plain, both = retrieval.bm25(docs, asked), retrieval.bm25(docs, asked, hits=hits)
    want = {(r.query_id, r.doc_id): (r.score, None, None) for r in plain.collect()}
    for h in hits.collect():
        want[h.query_id, h.doc_id] = (want.get((h.query_id, h.doc_id), (None,))[0], h.bonus, h.exact)
    assert {(r.query_id, r.doc_id): (r.score, r.bonus, r.exact) for r in both.collect()} == want
    for df in (plain, retrieval.min_max(plain)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]
        assert "Window" not in plan


def test_rounds_of_chains_follow_the_longest(spark, monkeypatch):
    """Many short chains take few rounds, nodes at their root are written once, and a cycle costs no rows of others."""
    written, plain = [], graph.cut

    def counted(df, name):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    links = [(10 * k + i, 10 * k + i + 1) for k in range(300) for i in range(k % 5)]
    got = {(r.root, r.node, r.place) for r in graph.chains(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {(10 * k, 10 * k + i, i) for k in range(300) if k % 5 for i in range(k % 5 + 1)}
    assert len(written) <= 4 and sum(written) < 2.5 * len(got)
    ring = [(-1, -2), (-2, -3), (-3, -1)]
    assert {(r.root, r.node, r.place) for r in graph.chains(spark.createDataFrame(links + ring, "src long, dst long")).collect()} == got


def test_parts_of_questions_are_computed_once(spark):
    """A question's core, words and lines are read once a row, however often the steps after them name them."""
    q = spark.createDataFrame([(1, "Which 'Unit 7' is near AB-7?\n- Do not guess")], "id long, text string")
    for made, mark in ((discourse.target_entities, "constraint|format"), (discourse.core_query, "constraint|format"), (discourse.task_boundary, "question|query|task")):
        plan = q.select(made(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count(mark) <= 3, made


def test_best_of_fused_lists_without_their_ranks(spark, monkeypatch):
    """The best of two fused lists equal those by full ranks, with ties, exact rows and heads that must be taken deeper."""
    rng = random.Random(11)
    monkeypatch.setattr(retrieval, "DEPTH", 2)
    lists = [[(q, d, round(rng.random(), 1), q % 2 == 1 and d % 7 == 0) for q in range(6) for d in range(80) if rng.random() < 0.7] for _ in range(2)]
    lexical, dense = (spark.createDataFrame(rows, "query_id long, doc_id long, score double, exact boolean") for rows in lists)
    dense = dense.drop("exact")
    plain = retrieval.reciprocal_ranks(lexical, dense).join(lexical.select("query_id", "doc_id", "exact"), ["query_id", "doc_id"], "left")
    plain = retrieval.top_k(plain.withColumn("score", F.round(F.col("score") + F.coalesce("exact", F.lit(False)).cast("int"), 8)), 5)
    got = retrieval.best_fused(retrieval.both_lists(lexical, dense), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select("query_id", "doc_id", "score", "rank").collect()))


def test_better_half_without_ranks(spark):
    """The half of each list that is scored again ends where full ranks say, in ties and for short and equal lists."""
    rng = random.Random(13)
    rows = [(q, d, 0.5 if q == 3 else round(rng.random(), 1 + q % 3)) for q in range(8) for d in range((1, 2, 5, 40, 41, 60, 300, 13)[q])]
    scores = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    want = set()
    for q in range(8):
        ranked = sorted(((-s, d) for x, d, s in rows if x == q))
        take = max(2, min(len(ranked), max(len(ranked) // 2, 6)))
        want |= {(q, d, float(d), 2) if i < take else (q, d, round(-s * 0.1, 6), 1) for i, (s, d) in enumerate(ranked)}
    got = ranking.cascade(scores, lambda c: c.select("query_id", "doc_id", F.col("doc_id").cast("double").alias("score")))
    assert {tuple(r) for r in got.collect()} == want


def test_marks_of_documents_are_joined_as_postings(spark):
    """Bonuses of entities are summed where a document's postings lie: no pair is shuffled, and repeated words are looked for."""
    docs = spark.createDataFrame([(1, "bell of Anna"), (2, "bell bell AB-36"), (3, "anna 36 ab"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "AB-36 \"bell bell\" Anna")], "query_id long, text string")
    found = {(r.doc_id, r.mark) for r in ranking.entity_marks(docs, asked)[0].collect()}
    assert found == {(1, "anna"), (2, "bell bell"), (2, "ab 36"), (3, "anna")}
    df = ranking.tiered(docs, asked)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]
    hits = {(r.query_id, r.doc_id): r.exact for r in ranking.entity_hits(docs, asked).collect()}
    assert hits == {(r.query_id, r.doc_id): r.exact for r in df.collect()} == {(7, 1): False, (7, 2): True, (7, 3): False}


def test_subsets_of_codes_are_not_broadcast(spark, monkeypatch):
    """Subsets outgrow what Spark knows of the sets they come from, so none of their joins sends a table through the driver (F1 of round 4)."""
    rng = random.Random(17)
    units = spark.createDataFrame([(k, [rng.randrange(30) for _ in range(k % 6)]) for k in range(600)], "doc_id long, codes array<long>")
    asked = units.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = ranking.best_by_concepts(units, asked, 5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(retrieval.top_k(ranking.concept_overlap(units, asked).where("query_id <> doc_id"), 5).collect())
    assert sorted(got.collect()) == want
    # a full filter and small batches change nothing
    monkeypatch.setattr(ranking, "PART_BITS", (64, 64))
    monkeypatch.setattr(ranking, "PARTS_AT_ONCE", 32)
    assert sorted(ranking.best_by_concepts(units, asked, 5).collect()) == want


def test_pairs_of_a_keep_policy_are_scored_once(spark, monkeypatch):
    """Kept units equal those of all scaled scores, for few and many cells at once, and the plan of the policy doesn't score pairs again (F2 of round 4)."""
    rng = random.Random(19)
    docs = spark.createDataFrame([(k, " ".join(f"word{rng.randrange(30)}" for _ in range(k % 40)) + (f" AB-{k % 5} of Anna Bell{k % 3}" if k % 2 else "")) for k in range(150)] + [(150, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"word{rng.randrange(34)}" for _ in range(5)) + f" AB-{q % 7} " + ("Anna Bell1" if q % 2 else "")) for q in range(12)] + [(12, "nowhere")], "query_id long, text string")
    monkeypatch.setattr(ranking, "_inputs", lambda s, d: (docs, asked))
    units = ranking.scaled(ranking.tiered(docs, asked)).join(docs.select("doc_id", ranking.token_estimate(F.col("text")).alias("tokens")), "doc_id")
    want = [tuple(r) for r in ranking.keep_units(ranking.cut(units), threshold=0.5, most=6, budget=1000).collect()]
    every = {(r.query_id, r.doc_id): (r.score, r.exact) for r in units.collect()}
    for cells in (4_000_000, 300):
        monkeypatch.setattr(ranking, "CELLS_AT_ONCE", cells)
        got = ranking.q_keep_exact(spark, "")
        assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in got.collect()] == want
        assert all(every[r.query_id, r.doc_id] == (r.score, r.exact) for r in ranking.tiered_scaled(docs, asked, 0.5).collect())
        assert {(r.query_id, r.doc_id): (r.score, r.exact) for r in ranking.tiered_scaled(docs, asked, 0.0).collect()} == every
