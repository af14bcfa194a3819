"""Gates between scales and folded books on small tables."""

from graphloom.operators.scales import folded_book, scale_gated, unfolded_group, verified_book


def test_gates(spark):
    edges = spark.createDataFrame([("a", "R", "b", None, None), ("b", "PART_OF_MACRO", "c", None, None), ("x", "R", "a", None, None), ("a", "S", "zz", "UNKNOWN", 0.5), ("c", "R", "a", "TRUE", 0.1), ("a", "R", "f", None, None)], "src string, rel string, dst string, truth string, confidence double")
    nodes = spark.createDataFrame([("a", "TRUE", 1.0, False), ("b", "UNKNOWN", 0.5, None), ("c", "TRUE", 0.2, True), ("x", "CONTRADICTION", 1.0, False), ("f", "FALSE", 0.8, False)], "node string, truth string, confidence double, coarse boolean")
    weight = lambda **kw: {(r["src"], r["dst"]): r["weight"] for r in scale_gated(edges, nodes, {"R": 0.8}, **kw).collect()}
    assert weight() == {("a", "b"): 0.4, ("b", "c"): 0.9, ("x", "a"): 0.0, ("a", "zz"): 0.45, ("c", "a"): 0.8, ("a", "f"): 0.0}
    assert weight(between=0.5, coarse=0.1, positive=False) == {("a", "b"): 0.4, ("b", "c"): 0.05, ("x", "a"): 0.0, ("a", "zz"): 0.45, ("c", "a"): 0.08, ("a", "f"): 0.16}


def test_book(spark):
    rows = [(b, c, k, b * 100 + c * 10 + k * 2 + j, f"t{j}", [1 << j, 4]) for b in range(2) for c in range(2) for k in range(2) for j in range(2)] + [(0, 0, 0, 99, None, [8])]
    leaves, levels = spark.createDataFrame(rows, "book int, chapter int, chunk int, node int, content string, vec array<long>"), ["book", "chapter", "chunk"]
    folds = folded_book(leaves, levels).collect()
    assert sorted((r["level"], r["path"]) for r in folds)[:3] == [("book", "0"), ("book", "1"), ("chapter", "0/0")] and len(folds) == 2 + 4 + 8
    assert {r["path"]: r["vec"] for r in folds}["0"] == [11, 4] and {r["path"]: r["members"] for r in folds}["0/0/0"] == 3
    stored = spark.createDataFrame(folds)
    sound = lambda df: {r["path"] for r in verified_book(stored, df, levels).collect() if not r["sound"]}
    assert sound(leaves) == set()
    assert sound(leaves.selectExpr("book", "chapter", "chunk", "node", "if(node = 110, 'other', content) AS content", "vec")) == {"1", "1/1", "1/1/0"}
    assert sound(leaves.where("NOT (book = 1 AND chapter = 0)")) == {"1", "1/0", "1/0/0", "1/0/1"}
    assert {r["node"] for r in unfolded_group(leaves, levels, "1/0").collect()} == {100, 101, 102, 103} and unfolded_group(leaves, levels, "0/0/0").count() == 3
