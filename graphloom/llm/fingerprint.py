"""Canonical exact fingerprints: native DataFrame functions only.

Canonical form: Unicode composition, full case folding, white space folded to single spaces.  The
fingerprint is a 128-bit xxHash of it; where two fingerprints are equal the canonical bytes are compared.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm._common import join_skewed, materialise, table

#: Documents that the neighbour search puts into one group.
GROUP_ROWS = 2000
_QUANTILES = 100


#: Leading, vowel and trailing Hangul jamo that compose, and the syllables.
_L, _V, _T, _SYLLABLES = r"\x{1100}-\x{1112}", r"\x{1161}-\x{1175}", r"\x{11A8}-\x{11C2}", r"\x{AC00}-\x{D7A3}"


#: Marks by the category the JVM knows (fast, where a class of many ranges is slow), and blocks with marks that are newer than it may be.
_MARKS = r"\p{M}\x{898}-\x{89F}\x{8CA}-\x{8D2}\x{C3C}\x{ECE}\x{1715}\x{180F}\x{1AC1}-\x{1AFF}\x{1DFA}\x{10D00}-\x{11FFF}\x{16A00}-\x{16FFF}\x{1BC00}-\x{1BCFF}\x{1CF00}-\x{1EFFF}"


@dataclass(frozen=True)
class _Unicode:
    """From Unicode's data, without the Hangul syllables: what normalisation and case folding need."""

    marks: str  #: characters with a combining class, and beside each a character that sorts by the class
    classes: str
    split: str  #: characters with a decomposition, longest first, and the n-th character of each (shorter ones are at the end)
    pieces: tuple[str, ...]
    pairs: dict[str, str]  #: two characters and the one they compose to
    near: str  #: character class with (at least) all that may join or move past what stands before, and all whose composed form is longer
    restless: str  #: characters that a composed text doesn't hold or that may join what stands before them
    single: str  #: characters with another one as their composed form, and these
    plain: str
    upper: str  #: characters that fold to one other character, and these
    lower: str
    longer: dict[str, str]  #: characters that fold to several


@lru_cache(1)
def _unicode() -> _Unicode:
    every = [chr(code) for code in range(0x110000) if not (0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3)]
    marks = [c for c in every if unicodedata.combining(c)]
    full = {c: d for c in every if (d := unicodedata.normalize("NFD", c)) != c}
    split = sorted(full, key=lambda c: -len(full[c]))
    pieces = ["".join(full[c][k] for c in split if len(full[c]) > k) for k in range(len(full[split[0]]))]
    pairs = {}
    for c in full:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
            pairs["".join(chr(int(x, 16)) for x in parts)] = c
    joins = {*marks, *(pair[1] for pair in pairs)}
    composed = {c: n for c in full if (n := unicodedata.normalize("NFC", c)) != c}
    single = [c for c in composed if len(composed[c]) == 1]
    loose = [c for c in every if (full.get(c, c)[0] in joins and unicodedata.category(c)[0] != "M") or (c in composed and len(composed[c]) > 1)]
    restless = {*composed, *(pair[1] for pair in pairs), *map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])}
    folded = {c: f for c in every if (f := c.casefold()) != c}
    upper = [c for c in folded if len(folded[c]) == 1]
    return _Unicode(
        "".join(marks), "".join(chr(0x100 + unicodedata.combining(c)) for c in marks), "".join(split), tuple(pieces), pairs, _MARKS + _ranges("".join(loose), 16),
        "".join(restless), "".join(single), "".join(composed[c] for c in single), "".join(upper), "".join(folded[c] for c in upper), {c: f for c, f in folded.items() if len(f) > 1},
    )


def _ranges(chars: str, gap: int = 1) -> str:
    """The inside of a character class that holds the characters; those closer than gap share a range (1: it holds no others)."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in out)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _decomposed(text: Column) -> Column:
    """Every character replaced by its full decomposition."""
    u = _unicode()
    pieces = lambda c: [F.translate(c, u.split, piece) for piece in u.pieces]
    one = lambda c: F.when(F.translate(c, u.split, u.pieces[0]) == c, c).otherwise(F.concat(*pieces(c)))
    return F.array_join(F.transform(_characters(text), one), "")


def _class_of(char: Column) -> Column:
    """A character that sorts by the combining class; empty for class 0."""
    u = _unicode()
    return _let(F.translate(char, u.marks, u.classes), lambda k: F.when(k == char, "").otherwise(k))


def _reordered(text: Column) -> Column:
    """Runs of marks in the order of their combining classes; marks of one class keep theirs."""
    u = _unicode()
    marks = _ranges(u.marks)
    runs = F.regexp_extract_all(text, F.lit(f"(?s)[{marks}]+|[^{marks}]+"), F.lit(0))
    keyed = lambda run: F.transform(_characters(run), lambda c, k: F.struct(_class_of(c).alias("class"), k.alias("k"), c.alias("c")))
    ordered = lambda run: F.array_join(F.transform(F.array_sort(keyed(run)), lambda m: m["c"]), "")
    several = F.array_join(F.transform(runs, lambda run: F.when((F.char_length(run) > 1) & (_class_of(F.substring(run, 1, 1)) != ""), ordered(run)).otherwise(run)), "")
    return F.when(F.char_length(text) > 1, several).otherwise(text)


def _recomposed(text: Column) -> Column:
    """Each character joined to the last starter where Unicode has the pair and no mark between blocks it."""
    u = _unicode()
    pairs = F.from_json(F.lit(_json(u.pairs)), "map<string,string>")
    state = lambda done, starter, tail, last: F.struct(done.alias("done"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))
    none = F.lit("")

    def step(s: Column, c: Column) -> Column:
        order = _class_of(c)
        blocked = (s["tail"] != "") & (s["last"] >= order)
        joined = F.when(~blocked, F.element_at(pairs, F.concat(s["starter"], c)))
        kept = F.when(order == "", state(F.concat(s["done"], s["starter"], s["tail"]), c, none, none)).otherwise(state(s["done"], s["starter"], F.concat(s["tail"], c), order))
        return F.when(joined.isNotNull(), state(s["done"], joined, s["tail"], s["last"])).otherwise(kept)

    return F.aggregate(_characters(text), state(none, none, none, none), step, lambda s: F.concat(s["done"], s["starter"], s["tail"]))


def _syllables(text: Column) -> Column:
    """Hangul jamo joined to syllables, by arithmetic."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)[{_L}][{_V}][{_T}]?|[{_SYLLABLES}][{_T}]|[^{_L}{_SYLLABLES}]+|."), F.lit(0))
    code = lambda x, k: F.ascii(F.substring(x, k, 1))
    tail = lambda x, k: F.when(F.char_length(x) >= k, code(x, k) - 0x11A7).otherwise(0)
    char = lambda n: F.decode(F.unhex(F.hex(n.cast("long"))), "UTF-16BE")

    def joined(x: Column) -> Column:
        jamo = char(0xAC00 + ((code(x, 1) - 0x1100) * 21 + code(x, 2) - 0x1161) * 28 + tail(x, 3))
        longer = F.when((code(x, 1) - 0xAC00) % 28 == 0, char(code(x, 1) + tail(x, 2))).otherwise(x)
        return F.when(x.rlike(f"^[{_L}][{_V}]"), jamo).when(x.rlike(f"^[{_SYLLABLES}][{_T}]"), longer).otherwise(x)

    return F.when(text.rlike(f"[{_V}{_T}]"), F.array_join(F.transform(parts, joined), "")).otherwise(text)


def _composed(text: Column) -> Column:
    """Unicode's composed form (NFC); only characters with marks, and those not composed themselves, are worked on."""
    u = _unicode()
    restless = lambda x: F.translate(x, u.restless, "") != x
    parts = F.regexp_extract_all(F.translate(text, u.single, u.plain), F.lit(f"(?s)[^{u.near}]+(?![{u.near}])|[^{u.near}]?[{u.near}]+"), F.lit(0))
    worked = lambda x: _let(_let(_decomposed(x), _reordered), _recomposed)
    needed = lambda x: x.rlike(f"[{u.near}]") & (restless(x) | x.rlike(f"[{u.near}]{{2}}"))
    whole = F.array_join(F.transform(parts, lambda x: F.when(needed(x), worked(x)).otherwise(x)), "")
    # below U+0300 all texts are composed; so are those without restless characters and neighbouring marks
    may = text.rlike(r"[^\x00-\x{2FF}]") & (restless(text) | text.rlike(f"[{u.near}]{{2}}"))
    return F.when(may, _let(whole, _syllables)).otherwise(text)


def _folded(text: Column) -> Column:
    """Full case folding, by Unicode's table in place of the lower case (whose sigma depends on what follows)."""
    u = _unicode()
    longer = F.from_json(F.lit(json.dumps([{"c": c, "f": f} for c, f in u.longer.items() if c != "ß"])), "array<struct<c: string, f: string>>")
    each = lambda x: F.aggregate(longer, x, lambda acc, p: F.replace(acc, p["c"], p["f"]))
    several = F.when(text.rlike(f"[{_ranges(''.join(u.longer).replace('ß', ''))}]"), each(text)).otherwise(text)
    return F.translate(F.replace(several, F.lit("ß"), F.lit("ss")), u.upper, u.lower)


def canonical(text: Column) -> Column:
    """The canonical form of a text column (a plain column, as it is named several times).

    Unicode's composed form, fully case folded and composed again, by the tables of Python's unicodedata;
    texts of ASCII alone are put into lower case, which is the same for them.
    """
    other = _let(_let(_composed(text), _folded), _composed)
    lowered = F.when(F.octet_length(text) > F.char_length(text), other).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(lowered, r"(?U)\s{2,}|[^\S ]", " "))


def _json(values: dict[str, str]) -> str:
    return json.dumps(values)


def wide_hash(text: Column) -> Column:
    """128 bits in lower-case hex: two 64-bit xxHashes with different seeds."""
    part = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(part(text), part(F.lit("second seed"), text))


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of a text column; equal texts have equal ones."""
    return df.withColumn("_canon", canonical(F.col(text))).withColumn(name, wide_hash(F.col("_canon"))).drop("_canon")


def _seen_filter(keys: DataFrame) -> DataFrame:
    """One row with an array of 64-bit words: a bitmap of the long column key of a written table, of a size that follows the rows up to 16 MB."""
    spark, rows = keys.sparkSession, keys.count()
    words = min(max(1 << 10, 1 << (rows // 2).bit_length()), 1 << 21)
    slot = F.pmod(F.col("key"), F.lit(64 * words))
    bits = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {64 * words}L) & 63 as int))").alias("b"))
    every = spark.range(words).select(F.col("id").cast("int").alias("w"))
    filled = every.join(bits.groupBy("w").agg(F.bit_or("b").alias("b")), "w", "left")
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("_bits"))


def _may_hold(bits: str, key: Column) -> Column:
    slot = F.pmod(key, F.lit(64) * F.size(bits))
    return F.expr(f"get({bits}, 0)").isNotNull() & (F.get(bits, F.shiftright(slot, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))) != 0)


def group_sizes(texts: DataFrame, known: DataFrame) -> DataFrame:
    """fingerprint, copies, variants: how many rows have a fingerprint, and how many different canonical texts they are (1 but for hash collisions).

    known (written): fingerprint of every row of texts (column text).  Bytes are compared for fingerprints that
    occur more than once: a bitmap of those, at most 16 MB, picks the rows where they lie, and each different
    text leaves a task once.
    """
    sizes = known.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    repeated = materialise(sizes.where("copies > 1").select(F.xxhash64("fingerprint").alias("key")), "repeated")
    rows = texts.select(canonical(F.col("text")).alias("canon")).withColumn("fingerprint", wide_hash(F.col("canon")))
    near = rows.join(F.broadcast(_seen_filter(repeated))).where(_may_hold("_bits", F.xxhash64("fingerprint"))).select("fingerprint", "canon")
    variants = near.groupBy("fingerprint", "canon").agg(F.count("*").alias("n")).groupBy("fingerprint").agg(F.count("*").alias("variants"))
    return sizes.join(variants, "fingerprint", "left").select("fingerprint", "copies", F.coalesce("variants", F.lit(1)).cast("long").alias("variants"))


def fingerprint_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, variant, copies: rows with equal fingerprint and variant have the same canonical bytes.

    variant numbers the different canonical texts of one fingerprint (0 but for hash collisions); copies
    is the size of the group.  Null texts count as empty.  Rows are counted where they lie before anything
    is shuffled, so a group of any size costs one row a task; texts move only for fingerprints that occur
    more than once, each different one once a task, and once more for those that hold several texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = materialise(rows.select("doc_id", wide_hash(canonical(F.col("text"))).alias("fingerprint")), "fingerprints")
    sizes = materialise(group_sizes(rows, known), "sizes")
    plain = join_skewed(known, sizes.where("variants = 1").select("fingerprint", "copies"), ["fingerprint"]).select("doc_id", "fingerprint", F.lit(0).alias("variant"), "copies")
    mixed = sizes.where("variants > 1").select("fingerprint")
    if mixed.isEmpty():
        return plain
    several = rows.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", wide_hash(F.col("canon"))).join(F.broadcast(mixed), "fingerprint", "left_semi")
    number = (F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1).alias("variant")
    variants = several.groupBy("fingerprint", "canon").agg(F.count("*").alias("copies")).select("fingerprint", "canon", "copies", number)
    return plain.unionByName(several.join(variants, ["fingerprint", "canon"]).select("doc_id", "fingerprint", "variant", "copies"))


def with_next(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs (doc_id, text) with fingerprint, next_text and next_fingerprint: of the document that follows in descending doc_id.

    After the last comes the first.  Rows that share an id follow each other in descending order of text;
    null ids come last.  Ids are cut into parts between quantiles and parts into ranges of about group_rows
    documents; only the first row of each range is needed outside it, and only the first range of each part
    (there are _QUANTILES of them at most) outside its part.  All rows of one id are in one range.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    stats = docs.select(key.alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("k", [k / _QUANTILES for k in range(_QUANTILES + 1)], 1000).alias("q")).first()
    bounds = sorted(set(stats["q"] or [0]))
    each = max(1, -(-stats["n"] // (group_rows * max(1, len(bounds) - 1))))
    lows, spans = bounds, [max(1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)] + [1]
    part = F.greatest(F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in lows]), lambda b: b <= key)) - 1, F.lit(0))
    low, span = (F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("_part")) for values in (lows, spans))
    inside = F.least(F.greatest(F.floor((key.cast("double") - low) / span * each), F.lit(0)), F.lit(each - 1))
    cut = docs.withColumn("_part", part).withColumn("_range", F.col("_part") * each + inside)
    w = Window.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = with_fingerprint(cut)
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w)})
    firsts = cut.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("_range").alias("_from"), "text")
    firsts = with_fingerprint(firsts).select("_from", F.col("text").alias("_text"), F.col("fingerprint").alias("_fp"))
    ranges = cut.select("_part", "_range").distinct()  # one row for group_rows documents
    after = F.lead("_range").over(Window.partitionBy("_part").orderBy(F.desc("_range")))
    tops = ranges.groupBy("_part").agg(F.max("_range").alias("_top"))  # a row for each part
    order = Window.orderBy(F.desc("_part"))
    highest = F.first("_top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("_part", F.coalesce(F.lead("_top").over(order), highest).alias("_top"))
    follow = ranges.withColumn("_after", after).join(F.broadcast(tops), "_part").select("_range", F.coalesce("_after", "_top").alias("_from"))
    follow = follow.join(firsts, "_from").drop("_from")
    joined = rows.join(follow, "_range", "left")
    return joined.withColumns({"next_text": F.coalesce("next_text", "_text"), "next_fingerprint": F.coalesce("next_fingerprint", "_fp")}).drop("_part", "_range", "_text", "_fp")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every document and of its edited text; and how many documents share its fingerprint, in how many different canonical texts."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(texts).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    docs = with_fingerprint(docs.withColumn("edited", edited), "edited", "edited_fingerprint")
    like = lambda fp, text: F.when((F.col("fingerprint") == F.col(fp)) & (canonical(F.col("text")) == canonical(F.col(text))), 1.0).otherwise(0.0)
    found = docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        like("edited_fingerprint", "edited").alias("near_edited"), like("next_fingerprint", "next_text").alias("near_next"),
    )
    found = materialise(found, "fingerprints")
    return join_skewed(found, materialise(group_sizes(texts, found), "sizes"), ["fingerprint"]).select(*found.columns, "copies", "variants")
