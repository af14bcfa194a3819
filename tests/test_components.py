"""Components, witnesses and cores against brute force."""

import random
from collections import defaultdict

import pytest

from graphloom.operators.components import components, condensed
from graphloom.operators.difference import negative_cycles


def brute_components(edges):
    after, before = defaultdict(set), defaultdict(set)
    for a, b in edges:
        after[a].add(b)
        before[b].add(a)

    def reach(x, step):
        seen, open_ = {x}, [x]
        while open_:
            for y in step[open_.pop()] - seen:
                seen.add(y)
                open_.append(y)
        return seen

    out = {}
    for n in {x for e in edges for x in e}:
        c = reach(n, after) & reach(n, before)
        out[n] = (min(c), len(c), len(c) > 1 or n in after[n])
    return out


@pytest.mark.parametrize("n, m, few", [(6, 9, 20_000), (120, 150, 0), (60, 200, 0)])
def test_components(spark, n, m, few):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1)], "src long, dst long")
    placed = components(df, few)
    got = {r["node"]: (r["component"], r["members"], r["cyclic"]) for r in placed.collect()}
    want = brute_components(edges)
    assert got == want
    between = {(want[a][0], want[b][0]) for a, b in edges if want[a][0] != want[b][0]}
    assert {tuple(r) for r in condensed(df, placed).collect()} == between


def test_long_ring_and_chain(spark):
    ring = spark.range(1200).selectExpr("id AS src", "(id + 1) % 1200 AS dst")
    chain = spark.range(10_000, 10_600).selectExpr("id AS src", "id + 1 AS dst")
    found = components(ring.union(chain), 300).groupBy("members", "cyclic").count().collect()
    assert sorted(map(tuple, found)) == [(1, False, 601), (1200, True, 1200)]


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert components(none).collect() == []
    assert negative_cycles(spark.createDataFrame([], "problem long, x string, y string, c double")).collect() == []


def solvable(constraints):
    d = {v: 0 for x, y, _ in constraints for v in (x, y)}
    for _ in range(len(d) + 1):
        moved = False
        for x, y, c in constraints:
            if d[y] + c < d[x]:
                d[x], moved = d[y] + c, True
        if not moved:
            return True
    return False


def test_negative_cycles(spark):
    rng = random.Random(3)
    rows = [(p, rng.randrange(n), rng.randrange(n), float(rng.randint(-1, 4))) for p in range(40) for n in [rng.choice([2, 4, 9, 20])] for _ in range(int(n * rng.choice([1, 1.5, 2.5])))]
    rows += [(90, k, (k + 1) % 150, 1.0 if k else -150.0) for k in range(150)] + [(91, k, (k + 1) % 150, 1.0 if k else -149.0) for k in range(150)]
    given = defaultdict(list)
    for p, x, y, c in rows:
        given[p].append((x, y, c))
    df = spark.createDataFrame([*rows, *rows[:5], (7, None, 1, -9.0)], "problem long, x long, y long, c double")
    found = defaultdict(list)
    for r in negative_cycles(df).sort("problem", "step").collect():
        found[r["problem"]].append(r)
    assert set(found) == {p for p, cs in given.items() if not solvable(cs)} and 90 in found and 91 not in found
    for p, cycle in found.items():
        assert [r["step"] for r in cycle] == list(range(len(cycle))) and len({r["y"] for r in cycle}) == len(cycle)
        assert cycle[0]["y"] == min(r["y"] for r in cycle) and all(a["x"] == b["y"] for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True))
        assert all((r["x"], r["y"], r["c"]) in given[p] for r in cycle) and sum(r["c"] for r in cycle) < 0


def test_cores_against_all_subsets(spark):
    from itertools import combinations

    from graphloom.operators import provenance

    rng = random.Random(6)
    names = "abcdefgh"
    rules = (((("a", "b")), "x"), (("c",), "x"), (("x", "d"), "y"), (("e",), "y"), (("y",), "z"), (("z", "f"), "e"))
    denials = (("1", ("x", "g"), ()), ("2", ("y", "h"), ("free",)), ("3", ("z", "x"), ()), ("4", ("a", "h"), ()))
    nodes = {n: {x for x in [*names, "free"] if rng.random() < (0.5 if x != "free" else 0.2)} for n in range(25)}

    def closed(facts):
        out = set(facts)
        while more := {c for p, c in rules if out >= set(p)} - out:
            out |= more
        return out

    want = set()
    for n, facts in nodes.items():
        found = []
        for rule, (a, b), excuses in denials:
            if closed(facts) & set(excuses):
                continue
            enough = []
            for s in (s for k in range(1, len(facts) + 1) for s in combinations(sorted(facts), k)):
                if {a, b} <= closed(s) and not any(set(t) <= set(s) for t in enough):
                    enough.append(s)
            found += [(rule, n, a, b, s) for s in enough]
        want |= {(*f, not any(set(g[4]) < set(f[4]) for g in found)) for f in found}
    df = spark.createDataFrame([(n, x) for n, facts in nodes.items() for x in facts] * 2 + [(None, "a"), (3, None)], "node long, fact string")
    got = {(r["rule"], r["node"], r["a"], r["b"], tuple(r["premises"]), r["irreducible"]) for r in provenance.cores(df, rules, denials).collect()}
    assert got == want and len(want) > 20


def test_total_order(spark):
    from graphloom.operators.components import total_order

    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    rows = total_order(spark.createDataFrame(edges, "src long, dst long")).collect()
    want, place = brute_components(edges), {r["node"]: r["place"] for r in rows}
    assert sorted(place.values()) == list(range(len(want)))
    assert {r["node"]: (r["component"], r["cyclic"]) for r in rows} == {n: (c, cyclic) for n, (c, _, cyclic) in want.items()}
    assert all(place[b] < place[a] for a, b in edges if want[a][0] != want[b][0])
    for r in rows:  # a component stands together
        own = [place[n] for n in want if want[n][0] == r["component"]]
        assert max(own) - min(own) == len(own) - 1
