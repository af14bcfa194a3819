"""The alignment ladder against a plain reading of it that compares every window."""

import difflib
import random
import re

import pytest

from graphloom.operators.span_align import aligned, closest, common_length, located


def slow_closest(text, target):
    words = [m.span() for m in re.finditer(r"\S+", text)]
    best, ratio = None, 0.0
    for i in range(len(words)):
        for j in range(i, min(i + 5, len(words))):
            a, b = words[i][0], words[j][1]
            if max(1, int(len(target) * 0.8)) <= b - a <= int(len(target) * 1.3) + 2:
                r = difflib.SequenceMatcher(None, target.lower(), text[a:b].lower()).ratio()
                if r > ratio:
                    best, ratio = (a, b), r
    return (*best, round(ratio, 3)) if best and ratio >= 0.7 else None


def test_windows_give_what_comparing_all_gives():
    rng = random.Random(3)
    hits = 0
    for _ in range(400):
        letters = rng.choice(["ab", "abcdef ", "abcİß é"])
        word = lambda n: "".join(rng.choice(letters.strip() or "a") for _ in range(rng.randint(1, n)))  # noqa: E731, B023
        text = " ".join(word(9) for _ in range(rng.randint(0, 25)))
        at = rng.randrange(len(text) + 1)
        target = (text[at : at + rng.randint(1, 20)] + word(2)).strip() or "q"
        got = closest(text, target)
        assert got == slow_closest(text, target), (text, target)
        hits += got is not None
    assert hits > 100
    long = "x" + "ab cd " * 80
    assert closest(long, long[3:240]) == slow_closest(long, long[3:240])


def test_common_length():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in "ab")
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert common_length(a, b) == rows[-1][-1]


@pytest.mark.parametrize(
    "text, span, hint, want",
    [
        ("the steel cylinder", "steel", 0, (4, 9, 1.0)), ("the steel cylinder", '"steel",', 0, (4, 9, 0.98)), ("The Steel cylinder", "the steel", 0, (0, 9, 0.95)), ("the steel \n cylinder", "steel cylinder", 0, (4, 20, 0.92)),
        ("two  Hot-rods\there", "hot rod", 0, (5, 13, 0.8)), ("a b a b", "b", 3, (6, 7, 1.0)), ("a b c", "b", 4, (2, 3, 1.0)), ("the cylindre", "cylinder", 0, (4, 12, 0.875)), ("nothing here", "zzzz", 0, None), ("", "a", 0, None), ("a", "", 0, None),
    ],
)
def test_rungs(text, span, hint, want):
    assert located(text, span, hint) == want


def test_stem_rung():
    assert located("the ſteels!", "steel", 0) == (4, 10, 0.88)  # a long s is the same letter in another case to patterns alone
    assert located("a-b  cAlmok", "calm", 0) == (5, 9, 0.95)  # any case comes first
    assert located("Öt almák", "ALMÁ", 0) == (3, 7, 0.95)


def test_rows_keep_their_columns(spark):
    rows = [(1, "é steel", "steel", 0), (2, None, "a", None), (3, "a", None, 0), (4, "abc abd", "abd", 9), (4, "abc abd", "abd", 9)]
    df = spark.createDataFrame(rows, "rest int, passage string, span string, h int").selectExpr("*", "'old' AS alignment")
    got = sorted((r["rest"], tuple(r["alignment"]) if r["alignment"] else None) for r in aligned(df, hint="h").collect())
    assert got == [(1, (2, 7, 3, 8, "steel", 1.0)), (2, None), (3, None), (4, (4, 7, 4, 7, "abd", 1.0)), (4, (4, 7, 4, 7, "abd", 1.0))]
