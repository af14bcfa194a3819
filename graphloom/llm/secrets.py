"""Secret scans with a trigram index: native DataFrame functions only.

Each rule's pattern is parsed and a Boolean query over trigrams derived from it, which every match must
satisfy; of the trigrams that must occur together the two rarest ask for all.  The postings of the trigrams
that queries mention are kept document-major, one bit vector per document, so that intersecting them is a
bit operation where the text lies and no text is shuffled.  A rule's candidates are the documents whose bits
satisfy its query; only on those does its pattern run, once.  A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import table


@dataclass(frozen=True)
class Rule:
    """pattern: Java and Python regular expression; a match counts if its group `part` has at least `least` characters."""

    name: str
    pattern: str
    part: int = 0
    least: int = 1


#: The three base rules, then those that are added.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3
#: Strings that one position of a pattern may stand for before its query gives them up.
_MOST = 16

Query = bool | str | tuple  # True: no condition; a trigram; ("and" | "or", queries)


def _join(kind: str, parts: list[Query]) -> Query:
    """An and/or of queries without the parts that decide nothing."""
    neutral = kind == "and"
    if not neutral and True in parts:
        return True
    parts = sorted({p for p in parts if p is not True}, key=str)
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _literal(strings: set[str]) -> Query:
    """Any of the strings occurs: all trigrams of one of them do."""
    return _join("or", [_join("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies; True if there is none."""
    parser = re._parser
    names = parser  # opcodes live beside the parser

    def strings_of(op, arg) -> set[str] | None:
        """The strings that a node stands for, if they are few."""
        if op is names.LITERAL:
            return {chr(arg).lower()}
        if op is names.IN:
            out: set[str] = set()
            for kind, value in arg:
                if kind is names.LITERAL:
                    out.add(chr(value).lower())
                elif kind is names.RANGE and value[1] - value[0] < _MOST:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= _MOST else None
        if op is names.SUBPATTERN:
            return whole(arg[3])
        if op is names.BRANCH:
            parts = [whole(p) for p in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if op is names.MAX_REPEAT and arg[1] is not names.MAXREPEAT and arg[1] <= 5:
            inner = whole(arg[2])
            if inner is not None:
                out = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(inner), repeat=n)} if len(inner) ** arg[1] <= _MOST else set()
                return out or None
        return None

    def whole(nodes) -> set[str] | None:
        out = {""}
        for op, arg in nodes:
            found = strings_of(op, arg)
            if found is None or len(out) * len(found) > _MOST:
                return None
            out = {a + b for a in out for b in found}
        return out

    def query(nodes) -> Query:
        parts: list[Query] = []
        run = {""}
        for op, arg in nodes:
            found = strings_of(op, arg)
            if found is not None and len(run) * len(found) <= _MOST:
                run = {a + b for a in run for b in found}
                continue
            parts.append(_literal(run))
            run = found if found is not None else {""}
            if found is None and op is names.SUBPATTERN:
                parts.append(query(arg[3]))
            elif found is None and op is names.BRANCH:
                parts.append(_join("or", [query(p) for p in arg[1]]))
            elif found is None and op is names.MAX_REPEAT and arg[0] > 0:
                parts.append(query(arg[2]))
        return _join("and", [*parts, _literal(run)])

    return query(parser.parse(pattern))


#: Letters of European texts from the commonest on.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


def _commonness(trigram: str) -> int:
    return sum(len(_LETTERS) - _LETTERS.index(c) if c in _LETTERS else 0 for c in trigram)


def rarest(query: Query, keep: int = 2) -> Query:
    """The query with at most `keep` trigrams of each set that must occur together: a weaker condition that costs less to look up."""
    if query is True or isinstance(query, str):
        return query
    parts = [rarest(q, keep) for q in query[1]]
    if query[0] == "and":
        single = sorted((q for q in parts if isinstance(q, str)), key=lambda t: (_commonness(t), t))
        parts = [q for q in parts if not isinstance(q, str)] + single[:keep]
    return _join(query[0], parts)


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def with_postings(df: DataFrame, vocabulary: list[str], text: str = "text", name: str = "postings") -> DataFrame:
    """df and the bit vectors of its texts: array<long>, bit k of the vector: trigram k of the vocabulary occurs (any case)."""
    lowered = df.withColumn("_lower", F.lower(text))
    words = [reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.contains("_lower", F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(vocabulary[at : at + 62]))) for at in range(0, len(vocabulary), 62)]
    return lowered.withColumn(name, F.array(*words)).drop("_lower")


def candidate(query: Query, vocabulary: list[str], name: str = "postings") -> Column:
    """Whether a document's bits satisfy a query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        k = vocabulary.index(query)
        return F.get(F.col(name), F.lit(k // 62)).bitwiseAND(F.lit(1 << k % 62).cast("long")) != 0
    parts = [candidate(q, vocabulary, name) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


_CHUNK = 64


def running_sums(numbers: Column) -> Column:
    """The sums of an array's numbers up to each of them.  Chunks are summed apart, so long arrays cost little more for each number."""
    add = lambda a, x: a + x
    total = lambda p: F.aggregate(p, F.lit(0), add)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _CHUNK).cast("int")), lambda k: F.slice(numbers, k * _CHUNK + 1, F.lit(_CHUNK)))

    def with_chunks(p: Column) -> Column:
        bases = lambda t: F.transform(t, lambda x, k: total(F.slice(t, F.lit(1), k)))
        inside = lambda b: F.flatten(F.transform(p, lambda c, k: F.transform(c, lambda x, j: F.get(b, k) + total(F.slice(c, F.lit(1), j + 1)))))
        return _let(_let(F.transform(p, total), bases), inside)

    return F.when(F.size(numbers) > 0, _let(chunks, with_chunks)).otherwise(F.array().cast("array<int>"))


def _spans(rule: Rule, number: int, candidates: Column) -> Column:
    """Spans of a rule as (start, kind number, stop) in code points.

    One pass of the pattern marks the matches; gaps and matches, in turn, make up the text, and their running
    lengths are the places.  (U+0001, the mark, counts as U+0002 in a text that holds it.)
    """
    if rule.part and re.search(r"\(\?(?:<?[=!])", rule.pattern):
        raise ValueError(f"{rule.name}: a pattern with look-around can't name a part")
    none = F.array().cast("array<struct<start: int, kind: int, stop: int>>")
    marked = F.regexp_replace(F.translate("text", "\u0001", "\u0002"), rule.pattern, "\u0001$0\u0001")

    def found(pieces: Column) -> Column:
        part = lambda p: F.regexp_extract(p, rule.pattern, rule.part) if rule.part else p
        span = lambda ends: F.transform(pieces, lambda p, k: F.struct((F.get(ends, k) - F.char_length(p)).alias("start"), F.lit(number).alias("kind"), F.get(ends, k).alias("stop")))
        every = _let(running_sums(F.transform(pieces, lambda p: F.char_length(p))), span)
        return F.filter(every, lambda s, k: (k % 2 == 1) & (F.char_length(part(F.get(pieces, k))) >= rule.least))

    return F.when(candidates & F.col("text").rlike(rule.pattern), _let(F.split(marked, "\u0001", -1), found)).otherwise(none)


def _searched(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, keep: list[str]) -> DataFrame:
    """rest (a struct of the columns named in keep, so that their names can't clash), text, secret_spans."""
    queries = [rarest(trigram_query(r.pattern)) for r in rules]
    vocabulary = sorted(set().union(*map(trigrams, queries)))
    df = docs.select(F.struct(*[docs[c] for c in keep]).alias("rest"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    df = with_postings(df, vocabulary) if vocabulary else df
    found = [_spans(r, k, candidate(q, vocabulary)) for k, (r, q) in enumerate(zip(rules, queries, strict=True))]
    return df.select("rest", "text", F.array_sort(F.concat(*found)).alias("secret_spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and secret_spans: array of (start, kind, stop) by start, kind, stop.

    kind is the rule's number; positions are code points of the whole text, stop exclusive.  Null texts
    count as empty; every row is searched on its own, repeated rows included; other columns are ignored.
    """
    return _searched(docs, rules, text_col, [id_col]).select(F.col("rest").getField(id_col).alias("doc_id"), "text", "secret_spans")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, in its own columns, with every secret span replaced by the mask (overlapping spans by one); null texts stay null."""
    found = _searched(docs, rules, text_col, docs.columns)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        wider = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))
        return F.when(s["start"] < acc["at"], wider).otherwise(F.struct(F.concat(acc["out"], gap, F.lit(mask)).alias("out"), s["stop"].alias("at")))

    done = F.aggregate("secret_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    own = F.col("rest").getField(text_col)
    text = F.when(own.isNotNull(), F.when(F.size("secret_spans") > 0, done).otherwise(own))
    return found.select(*[text.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _joined(spans: str, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: secrets in every document."""
    found = find_secrets(table(spark, sf_dir, "documents")).withColumn("base", F.filter("secret_spans", lambda s: s["kind"] < BASE))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k].name}")
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(_joined("base", RULES), 256).alias("base_sha256"), _joined("secret_spans", RULES).alias("spans"))


def _oracle(rules: tuple[Rule, ...]) -> str:
    """DuckDB SQL of the query: gaps and matches of each pattern give the positions."""
    parts = []
    for k, rule in enumerate(rules):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        lists = f"SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.part}) AS p, string_split_regex(text, {pattern}) AS g FROM d"
        at = "list_sum(list_transform(list_concat(g[1:i], m[1:i - 1]), lambda x: length(x)))"
        parts.append(f"SELECT doc_id, {k} AS k, '{rule.name}' AS kind, CAST({at} AS BIGINT) AS start, length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({lists})) WHERE length(p[i]) >= {rule.least}")
    span = "kind || ':' || start || ':' || (start + n)"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{rules[k].name}" for k in range(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY start, k, n) FILTER (k < {BASE}) AS base, string_agg({span}, ',' ORDER BY start, k, n) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{rules[k].name}, 0) AS n_{rules[k].name}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


OP10_SQL = _oracle(RULES)
