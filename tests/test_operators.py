import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.parsers import CodeGraph, CodeNodes, FormulaNodes, SexprNodes, parse_formula, parse_sexpr, write_formula, write_sexpr
from graphloom.operators import answers, difference, discourse, graph, kb, lexicon, memory, metrics, quaternary, ranking, resolve, retrieval, rules, spatial, stitch, temporal, text
from graphloom.plans import registry
from graphloom.sources import generators, scratch, stores
from graphloom.streaming import windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalised_answer_and_f1(spark):
    assert value(spark, text.normalize_answer(F.lit("The Cat, a dog!"))) == "cat dog"
    pairs = spark.createDataFrame([(1, "the cat sat", "cat sat down"), (2, "x", "y")], "k int, p string, g string")
    assert {r["k"]: r["f1"] for r in text.token_f1(pairs, "p", "g", ["k"]).collect()} == {1: 0.8, 2: 0.0}


def test_chunks_fill_up_and_cover_everything(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k} x. Y" for k in range(600))), (2, ""), (3, None)], "doc_id long, text string")
    rows = text.micro_chunks(docs).orderBy("doc_id", "chunk").collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert rows[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["words"] <= 350 for r in rows)
    blocks = text.macro_blocks(text.micro_chunks(docs)).collect()
    assert sum(b["words"] for b in blocks) == sum(r["words"] for r in rows)


def test_keep_policy_skips_what_does_not_fit(spark):
    units = spark.createDataFrame([(1, 1, 0.9, 900), (1, 2, 0.8, 500), (1, 3, 0.7, 90), (1, 4, 0.1, 5)], "query_id long, doc_id long, score double, tokens long")
    kept = [r["doc_id"] for r in retrieval.keep_units(units, threshold=0.5, most=5, budget=1000).collect()]
    assert kept == [1, 3]
    low = units.withColumn("score", F.col("score") / 10)
    assert [r["doc_id"] for r in retrieval.keep_units(low, threshold=0.5, most=5, budget=10).collect()] == [1]


def test_min_max_of_equal_scores_is_zero(spark):
    s = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], "query_id long, doc_id long, score double")
    assert {r["score"] for r in retrieval.min_max(s).collect()} == {0.0}


def test_reciprocal_ranks(spark):
    s = spark.createDataFrame([(1, 1, 2.0)], "query_id long, doc_id long, score double")
    assert retrieval.reciprocal_ranks(s, s).first()["score"] == round(0.2 / 31 + 0.8 / 31, 8)


def test_lattices(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2), (9, 1), (9, 3)], "slot int, v int")
    join = {r["slot"]: r["v"] for r in rows.groupBy("slot").agg(quaternary.slot_join(F.col("v"), F.col("slot")).alias("v")).collect()}
    meet = {r["slot"]: r["v"] for r in rows.groupBy("slot").agg(quaternary.slot_meet(F.col("v"), F.col("slot")).alias("v")).collect()}
    assert join == {0: 3, 9: 3} and meet == {0: 0, 9: 1}
    assert value(spark, quaternary.hamming(F.array(F.lit(0b0110)), F.array(F.lit(0b1101)))) == 2


def test_collisions_compare_whole_vectors(spark, tmp_path):
    x = [[0.2] * 64 for _ in range(4)]
    x[1][40], x[2][3] = -0.2, -0.2
    rows = spark.createDataFrame([(k, 0, v) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert tuple(quaternary.q_collisions(spark, str(tmp_path)).first()) == (4, 3, round(1 / 6, 9))


def test_information_of_all_slot_pairs(spark, tmp_path):
    x = [[0.2 if (k >> s % 3) & 1 else -0.2 for s in range(64)] for k in range(8)]
    spark.createDataFrame([(k, 0, v) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["i"], r["j"]): r["mi"] for r in registry.QUERIES["pairwise_mi"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): float((j - i) % 3 == 0) for i in range(64) for j in range(i + 1, 64)}


def test_gates(spark):
    g = lambda t, c, positive=True: round(value(spark, graph.gate_factor(F.lit(t), F.lit(c), positive)), 6)
    assert [g("CONTRADICTION", 0.9), g("TRUE", 0.3), g("UNKNOWN", 0.75), g("FALSE", 0.9)] == [0, 1, 0.75, 0]
    assert [g("FALSE", 0.9, False), g("FALSE", 0.3, False)] == [0.1, 0.7]


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("c", "a", 0.7)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0), ("z", 1.0)], "node string, weight double")
    assert abs(graph.personalized_pagerank(edges, seeds, 3).agg(F.sum("score")).first()[0] - 1) < 1e-9


def power(pairs, start, rounds):
    nodes = sorted({n for s, d, _ in pairs for n in (s, d)} | {start})
    at = {n: k for k, n in enumerate(nodes)}
    t, p0 = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for s, d, p in pairs:
        t[at[d], at[s]] = p
    p0[at[start]] = 1.0
    score = p0
    for _ in range(rounds):
        v = t @ score
        score = 0.85 * v + (0.15 + 0.85 * (1 - v.sum())) * p0
    return dict(zip(nodes, score, strict=True))


def test_pagerank_runs_to_its_tolerance(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("c", "a", 0.7), ("c", "d", 0.2)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, weight double")
    want = power([tuple(r) for r in graph.transition(edges).collect()], "a", 500)
    got = {r["node"]: r["score"] for r in graph.personalized_pagerank(edges, seeds, 50, tolerance=1e-6).collect()}
    assert got == pytest.approx(want, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pagerank_query_runs_twenty_rounds(spark):
    sf = "/root/testdata/sf0.001"
    want = power([tuple(r) for r in graph.transition(graph.edges_of(spark, sf)).select("src", "dst", "p").collect()], "R:0", 20)
    got = {r["node"]: r["score"] for r in graph.q_ppr(spark, sf).collect()}
    assert all(abs(got.get(n, 0.0) - v) < 2e-6 for n, v in want.items()) and set(got) <= set(want)


def test_clock_times(spark):
    cases = {"10:30 AM": 10.5, "12:00 AM": 0.0, "2:00 pm": 14.0, "14:30": 14.5, "at dawn": 6.0, "": None, "noon": 12.0, "in the afternoon": None}
    for raw, hours in cases.items():
        assert value(spark, temporal.clock_hours(F.lit(raw))) == hours


def test_as_of_is_half_open(spark):
    f = temporal.close_intervals(spark.createDataFrame([(1, "s", "x", 10.0, 1), (1, "s", "y", 14.0, 2)], "entity long, slot string, value string, t_start double, seq long"))
    asked = spark.createDataFrame([(1, 9.9), (1, 10.0), (1, 13.9), (1, 14.0)], "entity long, t double")
    assert [r["value"] for r in temporal.as_of(f, asked).orderBy("t").collect()] == [None, "x", "x", "y"]


def test_difference_constraints(spark):
    c = spark.createDataFrame([(1, "a", "b", -2.0), (1, "b", "a", 1.0), (2, "a", "b", -2.0), (2, "b", "a", 3.0)], "problem long, x string, y string, c double")
    assert {r["problem"]: r["consistent"] for r in difference.consistent(c).collect()} == {1: False, 2: True}


def test_calibration_and_truth(spark):
    assert [value(spark, metrics.truth_of(F.lit(p))) for p in (0.85, 0.15, 0.5)] == ["TRUE", "FALSE", "UNKNOWN"]
    df = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.1, 0)], "p double, y int")
    assert metrics.calibration_error(df, "p", "y").first()["ece"] == 0.1
    assert metrics.fit_temperature(df, "p", "y") < 1
    assert metrics.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert metrics.student_p(0.0, 5) == pytest.approx(1.0)


def test_edit_distances(spark):
    assert resolve.transposition_distance("ab", "ba") == 1 and resolve.transposition_distance("kitten", "sitting") == 3
    assert value(spark, resolve.levenshtein_similarity(F.lit("abcd"), F.lit("abcf"))) == 0.75


def test_rcc8(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    rel = lambda a, b: value(spark, spatial.rcc8(box(*a), box(*b)))
    unit = (0, 0, 1, 1)
    assert [rel(unit, unit), rel(unit, (1, 0, 2, 1)), rel(unit, (3, 3, 4, 4)), rel((0.2, 0.2, 0.4, 0.4), unit), rel(unit, (0.5, 0.5, 2, 2))] == ["EQ", "EC", "DC", "NTPP", "PO"]


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [(k % 3, "ab"[k % 2], float(k), f"2024-01-01 00:{k:02d}:00") for k in range(20)]
    events = spark.createDataFrame(rows, "user_id long, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    run(windows.latest_state(stream), "closed", "append")
    assert spark.table("closed").count() == 17
    run(windows.counts(stream, "5 minutes", late="1 minute"), "counted", "complete")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windows.counts(events, "5 minutes").collect()))


def test_lru_replay():
    assert windows.replay_lru([1, 2, 1, 3, 4], 2) == [2, 1]
    assert windows.replay_lru([1, 2, 3], 2, frozenset([1])) == [2]
    with pytest.raises(MemoryError):
        windows.replay_lru([1, 2, 3], 2, frozenset([1, 2]))


def test_dump_to_store(spark, tmp_path):
    link = lambda q: [{"mainsnak": {"datavalue": {"value": {"id": q}}}}]
    record = {"id": "Q42", "labels": {"en": {"language": "en", "value": "Douglas"}}, "aliases": {"en": [{"language": "en", "value": "DNA"}] * 2}, "claims": {"P31": link("Q5"), "P27": link("Q145"), "P9999": link("Q1")}}
    plain = {"id": "Q7", "claims": {"P31": link("Q9")}}
    (tmp_path / "dump.json").write_text("[\n" + json.dumps(record) + ",\n{broken\n" + json.dumps(plain) + "\n]\n")
    dump = stores.read_dump(spark, str(tmp_path / "dump.json"))
    row = stores.entities(dump).where("id = 'Q42'").first()
    assert (row["label"], row["category"], row["aliases"]) == ("Douglas", "human", ["DNA"])
    stores.write_store(dump, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/nodes")).count() == 1
    assert {(r["name"], r["object"]) for r in spark.read.parquet(str(tmp_path / "store/triples")).collect()} == {("INSTANCE_OF", "Q5"), ("CITIZENSHIP", "Q145")}


def test_upsert_and_resume(spark):
    old, new = (spark.createDataFrame(r, "id int, v string, seq int") for r in ([(1, "a", 1), (2, "b", 1)], [(1, None, 2), (3, "c", 2)]))
    assert {(r["id"], r["v"]) for r in stores.upsert(old, new, "id", "seq").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert [r["id"] for r in stores.remaining(new, old, "id").collect()] == [3]


def test_parsers(spark):
    tree = ["a", ["b", "c d"], 'e"f', ""]
    assert parse_sexpr(write_sexpr(tree)) == [tree]
    with pytest.raises(ValueError):
        parse_sexpr("(a (b)")
    assert parse_formula("∀x (P(x) → Q(x) ∧ ¬R(x))") == ("forall", "x", ("->", ("P", "x"), ("&", ("Q", "x"), ("~", ("R", "x")))))
    spark.udtf.register("sexpr_nodes", SexprNodes)
    spark.udtf.register("code_nodes", CodeNodes)
    assert spark.sql("SELECT head FROM sexpr_nodes('(a x (b y))') ORDER BY position").toPandas()["head"].tolist() == ["a", "b"]
    assert spark.sql("SELECT name, calls FROM code_nodes('def f():\\n    g()\\n')").first()["calls"] == ["g"]


def test_paths_and_dangling(spark):
    t = spark.createDataFrame([("a", "P", "b"), ("b", "Q", "c")], "subject string, property string, object string")
    start = spark.createDataFrame([("a",)], "node string")
    assert [tuple(r) for r in kb.path(t, start, ["P", "Q"]).collect()] == [("a", "c")]
    e = t.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    assert [r["dst"] for r in kb.dangling(e, t.select(F.col("subject").alias("node"))).collect()] == ["c"]


def test_pagerank_by_joins_equals_that_on_arrays(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.uniform(0, 1, 90), strict=True)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 2.0), (5, 1.0)], "node long, weight double")
    run = lambda n: {r["node"]: r["score"] for r in graph.personalized_pagerank(edges, seeds, 40, tolerance=1e-9, local_edges=n).collect() if r["score"] > 1e-12}
    local, joined = run(10**6), run(0)
    assert joined == pytest.approx(local, abs=1e-9) and sum(local.values()) == pytest.approx(1)
    nobody = seeds.withColumn("weight", F.lit(0.0))
    assert graph.personalized_pagerank(edges, nobody, 5).agg(F.sum("score")).first()[0] == pytest.approx(1)
    cut = graph.rank_nodes(edges, seeds, large=10, hops=1, least=0.0, most=100)
    assert {r["node"] for r in cut.collect()} <= set(local)


def test_levels_report_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "c2"), ("a", "c")], "child string, parent string")
    assert {r["node"]: r["level"] for r in graph.heights(e).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "c2": None}


def test_closure_of_a_ring_and_a_path(spark):
    e = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(10 + k, 11 + k) for k in range(9)], "src long, dst long")
    got = {(r["root"], r["node"]): r["depth"] for r in kb.closure(e).collect()}
    assert got == {(a, (a + d) % 5): d for a in range(5) for d in range(1, 6)} | {(10 + a, 10 + b): b - a for a in range(10) for b in range(a + 1, 10)}


def test_chains_leave_cycles_out(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9), (9, 8)], "src long, dst long")
    assert {r["node"]: (r["root"], r["place"]) for r in graph.chains(e).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3)}


def test_choices_numbers_and_extracts(spark):
    key = lambda t: value(spark, answers.choice_key(F.lit(t)))
    assert [key(t) for t in ("B", "(c)", "Answer: **D**", "Option A is wrong, the answer is C.", "B is correct", "so it goes", "A) first")] == ["B", "C", "D", "C", "B", None, "A"]
    num = lambda p, g: value(spark, answers.numeric_match(F.lit(p), F.lit(g)))
    assert num("we get **1,630** apples", "1630 apples") and not num("630 pears", "630 apples") and num("total is 5.00000001", "5") and not num("5 then 6 then 7", "5")
    ext = lambda p, g: value(spark, answers.extractive_match(F.lit(p), F.lit(g)))
    assert ext("Answer: Paris", "paris") and not ext("Answer: False", "true") and not ext("It cannot be determined whether Paris", "Paris") and ext("the city of Paris is it", "Paris") and not ext("Parisian", "Paris")
    assert value(spark, answers.sanitised(F.lit("Well. **Note** The answer is **Paris**."))) == "Paris"


def test_allen_constraints_find_contradictions(spark):
    r = spark.createDataFrame([(1, "a", "BEFORE", "b"), (1, "b", "BEFORE", "c"), (1, "c", "BEFORE", "a"), (2, "a", "DURING", "b"), (2, "b", "BEFORE", "c"), (3, "a", "EQUALS", "b"), (3, "a", "BEFORE", "b")], "problem long, a string, rel string, b string")
    assert {x["problem"]: x["consistent"] for x in difference.consistent(temporal.allen_constraints(r)).collect()} == {1: False, 2: True, 3: False}


def test_deletions_meet_within_two_edits(spark):
    lexicon = spark.createDataFrame([("kitten", 0), ("mitten", 0), ("banana", 5)], "entry string, priority int")
    words = spark.createDataFrame([("kittne",), ("mittn",), ("bnanaa",), ("zebra",), ("kitten",)], "word string")
    assert {r["word"]: (r["correction"], r["distance"]) for r in resolve.corrections(words, lexicon).collect()} == {"kittne": ("kitten", 1), "mittn": ("mitten", 1), "bnanaa": ("banana", 2), "kitten": ("kitten", 0)}


def test_names_and_categories(spark):
    assert value(spark, stitch.normal_name(F.lit("Prof. Dr. The Old Man"))) == "old man"
    ok = lambda a, b: value(spark, stitch.compatible(stitch.canonical_category(F.lit(a)), stitch.canonical_category(F.lit(b))))
    assert ok("human", "PERSON") and ok("object", "LOCATION") and ok("PERSON", "ANIMAL") and not ok("PERSON", "LOCATION")


def test_generators_follow_their_seed(spark):
    a, b = (generators.made_claims(generators.made_entities(spark, 50, seed=9).repartition(n), 50, seed=9) for n in (1, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 100
    kept = generators.quota(spark.range(100).select("id", (F.col("id") % 3).alias("g")), "g", 4)
    assert {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()} == {0: 4, 1: 4, 2: 4}


def test_fixpoint_and_grow_need_no_bound(spark):
    step = spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")
    found = scratch.grow(spark.createDataFrame([(0,)], "n long"), lambda f: f.join(step, F.col("n") == F.col("a")).select(F.col("b").alias("n")), ["n"])
    assert sorted(r["n"] for r in found.collect()) == list(range(13))


def test_weighted_choice_is_greedy(spark):
    rng = np.random.default_rng(1)
    m = {s: rng.uniform(0, 1, 4) for s in range(6)}
    mi = {(i, j): rng.uniform(0, 1) for i in range(6) for j in range(i + 1, 6)}
    got = quaternary.weighted_choice(spark.createDataFrame([(s, *map(float, v)) for s, v in m.items()], "slot int, f1 double, h double, necessity double, violations double"), spark.createDataFrame([(i, j, float(v)) for (i, j), v in mi.items()], "i int, j int, mi double"), 4)
    own = lambda s: float(m[s] @ [0.35, 0.25, 0.20, -0.05])
    taken = []
    for slot, gain in got:
        gains = {s: own(s) - 0.15 * np.mean([mi[min(s, t), max(s, t)] for t in taken] or [0]) / 2 for s in m if s not in taken}
        assert slot == max(gains, key=gains.get) and gain == pytest.approx(gains[slot], abs=1e-8)
        taken.append(slot)


def test_formulas_and_code_as_rows(spark):
    for text in ("forall x (P(x) -> Q(x) & ~R(x))", "A & (B | C) -> D <-> E", "~(A | B)", "(A -> B) -> C", "A -> B -> C"):
        assert parse_formula(write_formula(parse_formula(text))) == parse_formula(text)
    spark.udtf.register("formula_nodes", FormulaNodes)
    spark.udtf.register("code_edges", CodeGraph)
    assert [r["op"] for r in spark.sql("SELECT * FROM formula_nodes('P(x) & ~Q') ORDER BY number").collect()] == ["&", "P", "~", "Q"]
    assert {tuple(r) for r in spark.sql("SELECT * FROM code_edges('m', 'class A(B):\n    def f(self):\n        g()\n')").collect()} == {("m", "DEFINES", "m.A"), ("m.A", "INHERITS", "B"), ("m.A", "DEFINES", "m.A.f"), ("m.A.f", "CALLS", "g")}


def test_significance_and_settings(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 3.0), ("b", 2.0, 4.1), ("b", 3.0, 5.0)], "g string, x double, y double")
    got = {r["g"]: r for r in metrics.significance(rows, "x", "y", ["g"]).collect()}
    assert got["a"]["p"] == 1.0 and got["a"]["stars"] == "" and got["b"]["p"] < 0.01 and got["b"]["stars"]
    monkeypatch.setenv("GRAPHLOOM_DEPTH", "7")
    s = memory.Settings({"depth": 2, "theta": 0.5, "k": 3}, {"theta": 0.7, "depth": 3}, overrides={"k": 9})
    assert s.report() == [("depth", 7, "environment"), ("k", 9, "override"), ("theta", 0.7, "profile")]
    t = memory.Timings()
    for _ in range(2):
        with t.stage("x"):
            pass
    assert t.total["x"] >= 0


def test_store_report_and_drained_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, "50%")], "k int, v string")
    assert stores.report(rows, ["k", "v"]).splitlines()[1] == "| --- | --- |" and r"50\%" in stores.report(rows, ["k", "v"], "latex")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    edges = windows.chunk_pipeline(stream.select(F.col("k").alias("doc_id"), F.col("v").alias("text")), lambda c: c, lambda c: c.select("doc_id", "piece"))
    query = edges.writeStream.format("memory").queryName("pieces").option("checkpointLocation", str(tmp_path / "c")).start()
    assert windows.drained(query)["rows"] == 2
    query.stop()
    assert spark.table("pieces").count() == 2


def test_keep_policy_of_exact_units(spark):
    units = spark.createDataFrame([(1, 1, 0.9, 900, False), (1, 2, 0.1, 2000, True), (1, 3, 0.8, 90, False), (1, 4, 0.05, 3000, True)], "query_id long, doc_id long, score double, tokens long, exact boolean")
    kept = lambda **o: [r["doc_id"] for r in ranking.keep_units(units, **o).collect()]
    assert kept() == [1, 2, 3, 4] and kept(threshold=0.85) == [1, 2, 4] and kept(most=1) == [2, 4] and kept(budget=1000) == [2] and kept(threshold=0.5, most=4, budget=2200) == [2, 3]


def test_rules_of_one_node(spark):
    facts = spark.createDataFrame([("n", "TYPE_ANIMATE", 1), ("n", "GRAPH_ROOT_NODE", 1), ("n", "GRAPH_LEAF", 1), ("m", "GRAPH_LEAF", 1), ("m", "GRAPH_ROOT_NODE", 3)], "node string, slot string, v int")
    assert [tuple(r) for r in rules.conflicts(facts).collect()] == [("15 root", "n", "GRAPH_ROOT_NODE", "GRAPH_LEAF")]
    assert {r["slot"] for r in rules.deduced(facts).where("node = 'n'").collect()} >= {"ROLE_SENTIENT", "ROLE_MOVEABLE"}


def test_sentences_skip_one_boundary_after_an_abbreviation(spark):
    docs = spark.createDataFrame([(1, "He met Dr. Smith. She left! Mr. Mr. X. Y"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r["sentence"] for r in discourse.sentences(docs).orderBy("number").collect()] == ["He met Dr. Smith.", "She left!", "Mr. Mr.", "X.", "Y"]


def test_relevance_by_batches(spark):
    rows = spark.createDataFrame([(1, "a b", "b c"), (2, "", "x"), (3, None, None)], "k int, query string, text string")
    assert {r["k"]: r["relevance"] for r in lexicon.relevance(rows, lexicon.overlap_relevance, 2).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
