"""Aliases in texts against a plain matcher."""

import random
import re
from collections import Counter

import pytest

from graphloom.operators.alias_automaton import Trie, alias_matches, folded, leftmost_longest


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def pairs(s):
    return Counter(s[k : k + 2] for k in range(len(s) - 1))


def how_like(word, alias):
    w, a = folded(word), folded(alias)
    if len(w) < 3 or len(a) < 3 or w[:3] != a[:3]:
        return None
    if w.startswith(a) and len(w) - len(a) <= 6:
        return "prefix"
    if abs(len(w) - len(a)) > 4:
        return None
    dice = 2 * sum((pairs(w) & pairs(a)).values()) / (len(w) + len(a) - 2)
    return "fuzzy" if 1 - edits(w, a) / max(len(w), len(a)) >= 0.7 or dice >= 0.7 else None


def brute(texts, aliases):
    known = {}
    for i, a in aliases:
        a = (a or "").strip().lower()
        if len(a) >= 2:
            known.setdefault(a, set()).add(i)
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)", re.I)
    out = []
    for d, t in texts:
        t = t or ""
        found = [(m.start(), m.end(), m[0].lower()) for m in pattern.finditer(t)]
        out += [(d, a, b, t[a:b], x, i, "exact") for a, b, x in found for i in known[x]]
        taken = {x for _, _, x in found}
        for m in re.finditer(r"\w+", t):
            if m[0].lower() not in taken:
                out += [(d, *m.span(), m[0], a, i, how_like(m[0], a)) for a in known for i in known[a] if how_like(m[0], a)]
    return sorted(out)


@pytest.mark.parametrize("shard_chars", [4_000_000, 60])
def test_alias_matches(spark, shard_chars):
    rng = random.Random(5)
    stems = ["kutya", "Berlin", "Ana", "Anna Maria", "Maria", "New York", "York City", "New York City", "são paulo", "Łódź", "C++", "x", "ab", "interest", "internet", "Zürich"]
    aliases = [(k, s) for k, s in enumerate(stems)] + [(90, "berlin"), (91, None), (92, "  Ana ")]
    parts = [*stems, "kutyának", "Berlins", "Berlni", "internets", "Zurich", "ZÜRICH", "saopaulo", "anas", "Annamaria", "İstanbul", "C++x", "yorks", "interesting", "x_ab", "new york", "Maria.", "(Ana)"]
    texts = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(3, "Ana"), (None, "Berlin"), (70, None), (71, ""), (72, "kutya " * 3000)]
    t = spark.createDataFrame(texts, "doc_id int, text string").selectExpr("*", "'z' AS start", "1 AS rest", "2 AS spans")
    got = alias_matches(t, spark.createDataFrame(aliases, "id int, alias string"), shard_chars=shard_chars).collect()
    order = lambda rows: sorted(map(repr, rows))
    plain = sorted([(-1 if d is None else d, t) for d, t in texts], key=lambda x: x[0])
    assert order(tuple(r) for r in got) == order((None if r[0] == -1 else r[0], *r[1:]) for r in brute(plain, aliases))


def test_trie_and_overlaps():
    rng = random.Random(1)
    words = ["abc" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    trie = Trie(words[:60])
    for w in words[60:]:
        assert Counter(trie.near(w, 3, 0.7)) == Counter((a, how_like(w, a)) for a in words[:60] if how_like(w, a))
    assert leftmost_longest([(3, 5), (0, 2), (0, 4), (4, 6)]) == [(0, 4), (4, 6)]


def test_no_aliases_or_texts(spark):
    texts, none = spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([], "id int, alias string")
    assert alias_matches(texts, none).collect() == []
    assert alias_matches(texts.limit(0), spark.createDataFrame([(1, "abc")], "id int, alias string")).collect() == []
