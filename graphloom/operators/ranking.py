"""Ranking with named entities: tiers of matches, exact identifiers through every policy, cascades, routes and packing of passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import retrieval
from graphloom.operators.discourse import once, target_entities
from graphloom.operators.text import WORDS_TO_TOKENS, token_estimate, tokens, word_count
from graphloom.sources.scratch import cut
from graphloom.sources.tables import spread, table

#: What a match adds by its tier, and what it multiplies the score by.
BONUS = {"id": 8.0, "phrase": 6.0, "word": 4.0}
FACTOR_ID, FACTOR = 2.0, 1.5
#: Budget that units with an exact identifier get at least.
ID_BUDGET = 3500


def tier(entity: Column) -> Column:
    """id: holds a figure or is joined capitals; phrase: several words; word: one word of three letters or more; else null."""
    code = entity.rlike(r"[0-9]") | entity.rlike(r"^[A-Z0-9]{2,}(?:[-_][A-Z0-9]+)+$")
    return F.when(code, "id").when(F.contains(entity, F.lit(" ")), "phrase").when(F.char_length(entity) > 2, "word")


def entity_marks(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark: entities that stand in a document; query_id, mark, bonus, exact: what they are worth to a query).

    Entities meet documents by their words (an index of the queries' words alone); entities of several words
    are looked for in the documents that have them all.
    """
    spoken = lambda c: F.array_join(tokens(c), " ")
    asked = queries.select("query_id", F.explode(target_entities(F.col("text"))).alias("e")).select("query_id", spoken(F.col("e")).alias("mark"), tier(F.col("e")).alias("tier"))
    asked = cut(asked.where("tier IS NOT NULL AND mark <> ''").groupBy("query_id", "mark").agg(F.min("tier").alias("tier")), "entities")
    words = asked.select("mark", F.explode(F.array_distinct(F.split("mark", " "))).alias("term")).distinct()
    of_several = words.where(F.contains("mark", F.lit(" ")))
    wanted = of_several.groupBy("mark").agg(F.count("*").alias("n"))
    # the queries' words bound what is exploded of a document
    terms = cut(spread(docs.select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term")).join(retrieval.small(words.select("term").distinct()), "term", "left_semi"), "words")
    single = terms.join(retrieval.small(words.where("mark = term").select("term")), "term", "left_semi").select("doc_id", F.col("term").alias("mark"))
    have = terms.join(retrieval.small(of_several), "term").groupBy("mark", "doc_id").agg(F.count("*").alias("k")).join(retrieval.small(wanted), "mark").where("k = n")
    held = have.groupBy("doc_id").agg(F.collect_list("mark").alias("marks")).join(docs.select("doc_id", "text"), "doc_id")
    said = once(F.concat(F.lit(" "), spoken(F.coalesce("text", F.lit(""))), F.lit(" ")), lambda t: F.filter("marks", lambda m: F.contains(t, F.concat(F.lit(" "), m, F.lit(" ")))))
    several = held.select("doc_id", F.explode_outer(said).alias("mark")).where("mark IS NOT NULL")
    bonus = F.element_at(F.create_map(*[F.lit(x) for pair in BONUS.items() for x in pair]), F.col("tier"))
    return single.unionByName(several), asked.select("query_id", "mark", bonus.alias("bonus"), (F.col("tier") == "id").alias("exact"))


def entity_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, bonus, exact: summed bonuses of the entities of a query that stand in a document, and whether an identifier does."""
    found, worth = entity_marks(docs, queries)
    return found.join(worth, "mark").groupBy("query_id", "doc_id").agg(F.sum("bonus").alias("bonus"), F.bool_or("exact").alias("exact"))


def tiered(docs: DataFrame, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, exact: BM25 plus the bonuses, times a factor where there is any; documents that only entities find come too.

    among (doc_id): the documents that are scored, if not all.
    """
    j = retrieval.bm25(docs, queries, marks=entity_marks(docs, queries), among=among)
    exact, number = F.coalesce("exact", F.lit(False)), "decimal(18,6)"  # decimals, so that halves are rounded alike everywhere
    s, b = (F.coalesce(c, F.lit(0.0)).cast(number) for c in ("score", "bonus"))
    factor = F.when(exact, FACTOR_ID).otherwise(FACTOR).cast("decimal(2,1)")
    return j.select("query_id", "doc_id", F.when(b > 0, F.round((s + b) * factor, 6)).otherwise(s).cast("double").alias("score"), exact.alias("exact"))


def scaled(scores: DataFrame) -> DataFrame:
    """scores scaled to [0, 1] in their query; 0 where all are equal.  Extremes are aggregated, not windowed."""
    ends = scores.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    span = F.col("high") - F.col("low")
    return scores.join(F.broadcast(ends), "query_id").withColumn("score", F.when(span > 0, F.round((F.col("score") - F.col("low")) / span, 6)).otherwise(0.0)).drop("low", "high")


#: Numbers of a matrix that a task holds while it scores pairs.
CELLS_AT_ONCE = 4_000_000


def tiered_scaled(docs: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """query_id, doc_id, score, exact: `tiered`, scaled as by `scaled`, of the units that are exact, reach the threshold (of 0 to 1) or are the best of their query; some others come too.

    All pairs are scored, once, in matrix products where a document's postings lie.  Scores are 0 or more, so what is below
    the threshold times the best score that a task has met can't reach it; a task gives out the rest, and the ends of its scores.
    """
    terms, postings, stats = retrieval.postings_of(docs, queries)
    found, worth = entity_marks(docs, queries)
    total, average = stats.first()
    tf = postings.where(F.col("term") != retrieval._LENGTH)
    asked = terms.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").where("query_id IS NOT NULL").select("query_id", "term", "qtf", "df").toArrow()
    given = worth.where("query_id IS NOT NULL").select("query_id", "mark", "bonus", "exact").toArrow()
    queries_, (of_term, of_mark) = _numbered(asked.column("query_id"), given.column("query_id"))
    words, (word,) = _numbered(asked.column("term"))
    marks, (mark,) = _numbered(given.column("mark"))
    df = asked.column("df").to_numpy()
    weight = np.log((float(total) - df + 0.5) / (df + 0.5) + 1) * asked.column("qtf").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((queries_.to_numpy(), len(words), len(marks), (word, of_term, weight), (mark, of_mark, given.column("bonus").to_numpy(), given.column("exact").to_numpy(zero_copy_only=False))))
    names = docs.sparkSession.createDataFrame(pa.table({"term": words.cast(pa.string()), "at": pa.array(np.arange(len(words)))}))
    names_of_marks = docs.sparkSession.createDataFrame(pa.table({"mark": marks.cast(pa.string()), "at": pa.array(np.arange(len(marks)) + len(words))}))
    norm = F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("len") / (average if average > 0 else 1.0))
    rows = tf.join(retrieval.small(names), "term").select("doc_id", "at", (F.col("tf") * (retrieval.K1 + 1) / norm).alias("w"))
    rows = rows.unionByName(found.join(retrieval.small(names_of_marks), "mark").select("doc_id", "at", F.lit(1.0).alias("w"))).where("doc_id IS NOT NULL")
    bar = min(1.0, max(0.0, threshold - 1e-6))  # scaled scores are rounded

    def dense(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows_: int, first: int, last: int) -> np.ndarray:
        met = (entries[1] >= first) & (entries[1] < last)
        return np.bincount(entries[0][met] * (last - first) + entries[1][met] - first, entries[2][met], rows_ * (last - first)).reshape(rows_, last - first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n_words, n_marks, by_term, by_mark = shared.value
        wide = max(1, n_words + n_marks)
        width = min(max(1, len(ids)), max(1, CELLS_AT_ONCE // wide))
        many = max(1, CELLS_AT_ONCE // max(wide, width))
        low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
        made = {}

        def weights(first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if first not in made:
                made.clear()  # one block is held
                made[first] = dense(by_term, n_words, first, last), dense(by_mark[:3], n_marks, first, last), dense((*by_mark[:2], by_mark[3].astype(float)), n_marks, first, last)
            return made[first]

        def scored(key: np.ndarray, at: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
            own, place = np.unique(key, return_inverse=True)
            cuts = np.searchsorted(place, np.arange(0, len(own) + many, many))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                held = own[k * many : (k + 1) * many]
                x = np.bincount((place[a:b] - k * many) * wide + at[a:b], w[a:b], len(held) * wide).reshape(len(held), wide)
                for first in range(0, len(ids), width):
                    last = min(len(ids), first + width)
                    of_words, bonus, exact = weights(first, last)
                    raw, more, sure = x[:, :n_words] @ of_words, x[:, n_words:] @ bonus, x[:, n_words:] @ exact > 0
                    t, extra = np.rint(raw * 1e6).astype(np.int64), np.rint(more * 1e6).astype(np.int64)
                    tenths = np.where(sure, round(FACTOR_ID * 10), round(FACTOR * 10))
                    t = np.where(extra > 0, ((t + extra) * tenths * 2 + 10) // 20, t)  # halves are rounded up
                    there = (raw > 0) | (extra > 0)
                    low[first:last] = np.minimum(low[first:last], np.where(there, t, np.iinfo(np.int64).max).min(axis=0))
                    high[first:last] = np.maximum(high[first:last], np.where(there, t, -1).max(axis=0))
                    r, q = np.nonzero(there & (sure | (t >= bar * high[first:last])))
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[first + q]), pa.array(held[r]), pa.array(t[r, q] / 1e6), pa.array(sure[r, q]), pa.nulls(len(r), pa.float64()), pa.nulls(len(r), pa.float64())], columns)

        columns, rest = ["query_id", "doc_id", "score", "exact", "low", "high"], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:  # sorted by document; the last one may go on in the next batch
            rest = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(rest)]
            done = np.searchsorted(rest[0], rest[0][-1]) if len(rest[0]) else 0
            if done:
                yield from scored(*(x[:done] for x in rest))
                rest = [x[done:] for x in rest]
        if len(rest[0]):
            yield from scored(*rest)
        met = np.nonzero(high >= 0)[0]
        nothing = lambda kind: pa.nulls(len(met), kind)
        yield pa.RecordBatch.from_arrays([pa.array(ids[met]), nothing(pa.int64()), nothing(pa.float64()), nothing(pa.bool_()), pa.array(low[met] / 1e6), pa.array(high[met] / 1e6)], columns)

    pairs = float(total) * len(queries_)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, 1 + int(pairs) // (5 * retrieval.PAIRS_AT_ONCE))
    dealt = rows.select(F.col("doc_id").cast("long"), F.col("at").cast("long"), "w").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    out = cut(dealt.mapInArrow(run, "query_id long, doc_id long, score double, exact boolean, low double, high double"), "scores")
    ends = out.where("doc_id IS NULL").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    span = F.col("high") - F.col("low")
    scores = out.where("doc_id IS NOT NULL").select("query_id", "doc_id", "score", "exact").join(F.broadcast(ends), "query_id")
    return scores.select("query_id", "doc_id", F.when(span > 0, F.round((F.col("score") - F.col("low")) / span, 6)).otherwise(0.0).alias("score"), "exact")


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The different values of all columns, and the places of each column's values among them."""
    every = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).unique()
    return every, [np.asarray(pc.index_in(x, every)).astype(np.int64) for x in columns]


def keep_units(units: DataFrame, *, threshold: float | None = None, most: int | None = None, budget: int | None = None) -> DataFrame:
    """The kept units of each query in document order: query_id, doc_id, score, tokens, exact.

    units: query_id, doc_id, score, tokens, exact.  Without any limit all stay.  Exact units go first, pass
    every threshold, are never beyond the places (which they use up) and have ID_BUDGET tokens at least;
    where nothing passes the threshold the best unit stays; the first is kept whatever it costs, and one that
    doesn't fit is skipped while smaller ones after it may still fit.
    """
    columns = ["query_id", "doc_id", "score", "tokens", "exact"]
    if threshold is None and most is None and budget is None:
        return units.select(columns).orderBy("query_id", "doc_id")
    if threshold is not None:  # what is left out here comes after all that can stay, so ranks don't change
        best = units.groupBy("query_id").agg(F.max("score").alias("_best"))
        units = units.join(F.broadcast(best), "query_id").where(F.col("exact") | (F.col("score") >= threshold) | F.col("score").eqNullSafe(F.col("_best"))).drop("_best")
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "doc_id")
    ranked = units.withColumn("rank", F.row_number().over(w))
    if threshold is not None:
        ranked = ranked.where(F.col("exact") | (F.col("score") >= threshold) | (F.col("rank") == 1))
    if most is not None:
        ranked = ranked.where(F.col("exact") | (F.col("rank") <= most))
    if budget is not None:
        most_of = F.when(F.col("exact"), max(budget, ID_BUDGET)).otherwise(budget).cast("long")
        # what is beyond the whole budget never fits
        rows = ranked.select(*columns, "rank", most_of.alias("_most")).where((F.col("rank") == 1) | (F.col("tokens") <= F.col("_most")))

        def fold(group: pa.Table) -> pa.Table:
            group, used, kept = group.sort_by("rank"), 0, []
            for k, (cost, limit) in enumerate(zip(group.column("tokens").to_pylist(), group.column("_most").to_pylist(), strict=True)):
                if not kept or used + cost <= limit:
                    used = float("inf") if cost is None else used + cost  # nothing fits after a unit of unknown cost
                    kept.append(k)
            return group.select(columns).take(kept)

        ranked = rows.groupBy("query_id").applyInArrow(fold, units.select(columns).schema)
    return ranked.select(columns).orderBy("query_id", "doc_id")


def fused(lexical: DataFrame, dense: DataFrame, n: int, *, k: int = 30, w_lexical: float = 0.2, w_dense: float = 0.8, bypass: float | None = None) -> DataFrame:
    """query_id, doc_id, score, place: the n best by reciprocal ranks of both lists, 1 more for an exact identifier.

    lexical: query_id, doc_id, score, exact; dense: query_id, doc_id, score.  With bypass, a query whose best
    dense score reaches it and that has no exact unit is ranked by the dense list alone, equal scores on equal places.
    """
    both = retrieval.both_lists(lexical, dense)
    best = lambda rows: retrieval.best_fused(rows, n, k=k, w_lexical=w_lexical, w_dense=w_dense)
    if bypass is None:
        return best(both)
    hot = both.groupBy("query_id").agg(F.max("dense").alias("m"), F.bool_or("exact").alias("e")).where((F.col("m") >= bypass) & ~F.col("e")).select("query_id")
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    alone = both.where("dense IS NOT NULL").join(hot, "query_id", "left_semi").select("query_id", "doc_id", F.col("dense").alias("score")).withColumn("place", place).where(F.col("place") <= n)
    return best(both.join(hot, "query_id", "left_anti")).unionByName(alone)


#: Ranges that a list's scores are counted in to find its middle.
RANGES = 1000


def cascade(scores: DataFrame, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, doc_id, score, stage: the better half of each query's list (six at least, two if there are no more) is scored again; what is rejected keeps a tenth of its score.

    scores: query_id, doc_id, score and what second needs, read several times; second: from candidates (columns of scores)
    to query_id, doc_id, score.  No list is sorted: the last score that is chosen is found by counts of ranges of
    scores, then of the scores of one range; only rows of that score are ranked, by doc_id.
    """
    ends = scores.groupBy("query_id").agg(F.min("score").alias("_low"), F.max("score").alias("_high"), F.count("*").alias("_n"))
    ends = ends.withColumn("_take", F.greatest(F.lit(2), F.least(F.col("_n"), F.greatest(F.floor(F.col("_n") / 2), F.lit(6)))))
    span = F.col("_high") - F.col("_low")
    at = F.when(span > 0, F.floor((F.col("score") - F.col("_low")) / span * RANGES)).otherwise(F.lit(0).cast("long"))

    def reaching(counted: DataFrame, step: str) -> DataFrame:
        """The step (from above) with which the counted rows (query_id, step, c, _take) reach what is taken; _take is what is taken of it."""
        w = Window.partitionBy("query_id").orderBy(F.desc(step))
        t = counted.withColumn("_sum", F.sum("c").over(w)).withColumn("_more", F.lead(F.lit(1)).over(w).isNull())
        t = t.where((F.col("_sum") - F.col("c") < F.col("_take")) & ((F.col("_sum") >= F.col("_take")) | F.col("_more")))
        return t.select("query_id", F.col(step).alias(f"_{step}"), (F.col("_take") - (F.col("_sum") - F.col("c"))).alias("_take"))

    ranged = scores.join(retrieval.small(ends), "query_id").withColumn("range", at)
    middle = reaching(ranged.groupBy("query_id", "range", "_take").agg(F.count("*").alias("c")), "range")
    within = ranged.drop("_take").join(retrieval.small(middle), "query_id").where(F.col("range") == F.col("_range"))
    bar = cut(reaching(within.groupBy("query_id", "score", "_take").agg(F.count("*").alias("c")), "score"), "bars")
    ties = scores.join(retrieval.small(bar), "query_id").where(F.col("score") == F.col("_score")).select("query_id", "doc_id", "_score", "_take")
    ties = ties.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("_r") <= F.col("_take"))
    bar = cut(ties.groupBy("query_id", "_score").agg(F.max("doc_id").alias("_last")), "bars")
    met = scores.join(retrieval.small(bar), "query_id")
    chosen = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("doc_id") <= F.col("_last")))
    kept = second(met.where(chosen).select(*scores.columns)).select("query_id", "doc_id", "score", F.lit(2).alias("stage"))
    return kept.unionByName(met.where(~chosen).select("query_id", "doc_id", F.round(F.col("score") * 0.1, 6).alias("score"), F.lit(1).alias("stage")))


def route(coverage: Column, dense: Column, hot: float = 0.8, enough: float = 0.75) -> Column:
    """struct(mode, coverage): raw for a very close passage (coverage counts as 1) or enough coverage, else hot."""
    close = F.coalesce(dense >= hot, F.lit(False))
    return F.struct(F.when(close | (coverage >= enough), "raw").otherwise("hot").alias("mode"), F.when(close, 1.0).otherwise(coverage).alias("coverage"))


def concept_overlap(units: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score: share of the query's different codes (column codes) that the unit has; only units with one."""
    q = queries.select("query_id", F.array_distinct("codes").alias("codes")).where(F.size("codes") > 0)
    asked = q.select("query_id", F.size("codes").alias("n"), F.explode("codes").alias("code"))
    held = units.select("doc_id", F.explode(F.array_distinct("codes")).alias("code")).join(retrieval.small(asked.select("code").distinct()), "code", "left_semi")
    return held.join(asked, "code").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("k")).select("query_id", "doc_id", F.round(F.col("k") / F.col("n"), 6).alias("score"))


#: Codes up to which all subsets of a set are listed.
SUBSET_CODES = 16
#: Bits of the filter of asked subsets: about 16 for each, between these bounds (at most 64 MB); a fuller filter lets more rows through, never fewer.
PART_BITS = (1 << 16, 1 << 29)
#: Bits of the filter that one task makes, and subsets that a task holds before it gives them out.
PIECE_BITS, PARTS_AT_ONCE = 1 << 20, 1 << 20


def _mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    """Codes as 64-bit hashes (splitmix64)."""
    x = codes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _subsets(keys: np.ndarray, codes: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, a, b, n: the subsets of the sets of codes that are not empty, with their sizes; a and b, sums of hashes, are 128 bits that tell subsets apart."""
    values, ends = codes.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(pc.list_value_length(codes)))
    sizes = np.diff(ends, prepend=0)
    for k in np.unique(sizes[sizes > 0]):
        rows, step = np.nonzero(sizes == k)[0], max(1, PARTS_AT_ONCE >> int(k))
        count = np.zeros(1, np.int32)
        for _ in range(k):
            count = np.concatenate([count, count + 1])
        for at in range(0, len(rows), step):
            piece = rows[at : at + step]
            held, sums = values[(ends[piece] - k)[:, None] + np.arange(k)], []
            for seed in (0x1234567, 0x7654321):
                h, made = _mixed(held, seed), np.zeros((len(piece), 1), np.uint64)
                for j in range(k):
                    made = np.concatenate([made, made + h[:, j : j + 1]], axis=1)
                sums.append(made[:, 1:].ravel())
            yield np.repeat(keys[piece], len(count) - 1), sums[0], sums[1], np.tile(count[1:], len(piece))


def _looked(asked: DataFrame) -> DataFrame:
    """a, b, id, n: the subsets of asked sets (id, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, a, b, n in _subsets(batch.column(0).to_numpy(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key), pa.array(n)], ["a", "b", "id", "n"])

    return asked.select("id", "codes").mapInArrow(run, "a long, b long, id long, n int")


def _part_filter(looked: DataFrame) -> Broadcast:
    """A bitmap of the asked subsets by their first key; its pieces are made in the tasks."""
    size = min(max(PART_BITS[0], 1 << (16 * looked.count()).bit_length()), PART_BITS[1])
    bit = F.col("a").bitwiseAND(size - 1)

    def piece(table_: pa.Table) -> pa.Table:
        bits = np.zeros(min(size, PIECE_BITS), bool)
        bits[table_.column("bit").to_numpy() & (PIECE_BITS - 1)] = True
        return pa.table({"place": table_.column("place").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = looked.select(bit.alias("bit"), F.shiftright(bit, PIECE_BITS.bit_length() - 1).alias("place")).groupBy("place").applyInArrow(piece, "place long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for row in made.toLocalIterator():
        out[row.place * PIECE_BITS // 8 :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return looked.sparkSession.sparkContext.broadcast(out)


def _first_of_parts(units: DataFrame, filled: Broadcast, most: int) -> DataFrame:
    """a, b, doc_id: subsets of units (doc_id, codes) that the filter may hold, of each the `most` first units of a stretch of rows or fewer left out."""

    def firsts(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((key, b, a))
        a, b, key = a[order], b[order], key[order]
        kept = np.ones(len(a), bool)
        kept[most:] = (a[most:] != a[:-most]) | (b[most:] != b[:-most])
        return a[kept], b[kept], key[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = filled.value, [], 0
        last = np.uint64(8 * len(bits) - 1)
        out = lambda a, b, key: pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key)], ["a", "b", "doc_id"])
        for batch in batches:
            for key, a, b, _ in _subsets(batch.column(0).to_numpy(), batch.column(1)):
                bit = a & last
                met = np.nonzero(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)[0]
                held.append((a[met], b[met], key[met]))
                n += len(met)
                if n >= 2 * PARTS_AT_ONCE:
                    now = firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [now], len(now[0])
                    if n >= PARTS_AT_ONCE:
                        yield out(*now)
                        held, n = [], 0
        if n:
            yield out(*firsts(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return units.select("doc_id", "codes").mapInArrow(run, "a long, b long, doc_id long")


def best_by_concepts(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of concept_overlap for every query, itself excepted; ties by doc_id.

    codes: numbers.  Equal sets of codes are one class, of units (by their k + 1 first ids) and of queries.  A unit among
    the k + 1 best of a query has fewer than k + 1 before it, and all units that hold what it shares with the query and
    have smaller ids are before it; so it is among the first k + 1 units of that subset of the query's codes, and no more
    are kept of any subset.  Classes of more than SUBSET_CODES codes are few and meet the others code by code.

    Subsets are many more than the sets that are read, which Spark's sizes of tables don't see; so joins of them are by
    sorting, and only a filter of a bounded size is broadcast.
    """
    most = k + 1
    codes = F.array_sort(F.array_distinct(F.col("codes").cast("array<long>"))).alias("codes")
    first = lambda df, *of: df.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy("doc_id"))).where(F.col("_r") <= most).drop("_r")
    # written, as the branches below read them several times
    reps = cut(first(units.select(F.col("doc_id").cast("long"), codes).where(F.size("codes") > 0), "codes"), "units")
    wanted = cut(queries.select("query_id", codes).where(F.size("codes") > 0), "asked")
    asked = cut(wanted.select("codes").distinct().withColumn("id", F.monotonically_increasing_id()), "classes")
    few = F.size("codes") <= SUBSET_CODES
    looked = _looked(asked.where(few))
    held = first(_first_of_parts(reps.where(few), _part_filter(looked), most), "a", "b")
    found = looked.hint("merge").join(held, ["a", "b"]).groupBy("id", "doc_id").agg(F.max("n").alias("n"))

    def plain(u: DataFrame, q: DataFrame) -> DataFrame:
        return u.select("doc_id", F.explode("codes").alias("code")).join(q.select("id", F.explode("codes").alias("code")).hint("merge"), "code").groupBy("id", "doc_id").agg(F.count("*").cast("int").alias("n"))

    found = found.unionByName(plain(reps.where(~few), asked)).unionByName(plain(reps.where(few), asked.where(~few)))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "doc_id"))
    best = found.withColumn("_r", place).where(F.col("_r") <= most).join(asked.hint("merge"), "id")
    scores = best.join(wanted.hint("merge"), "codes").where("query_id <> doc_id").select("query_id", "doc_id", F.round(F.col("n") / F.size("codes"), 6).alias("score"))
    return retrieval.top_k(scores, k)


#: Words that the header of a packed passage costs, and tokens that it costs where passages are chosen.
HEADER_WORDS, HEADER_TOKENS = 15, 10


def packed(passages: DataFrame, budget: int) -> DataFrame:
    """query_id, doc_id, place: the passages of a context of so many tokens, in document order.

    passages: query_id, doc_id, score, words (empty ones don't count).  If not all fit, the best are chosen first,
    skipping those that don't fit (the first always is); then they are laid down in document order up to the
    first that doesn't fit (the first always is).
    """
    most = max(1, int(budget / WORDS_TO_TOKENS))
    rows = passages.where("words > 0").withColumn("cost", (F.col("words") + HEADER_WORDS).cast("long"))
    kind = "array<struct<neg: double, doc_id: long, cost: long>>"

    def fold(source: Column, skip: bool) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.array().cast(kind).alias("kept"))

        def step(acc: Column, x: Column) -> Column:
            fits = (F.size(acc["kept"]) == 0) | (acc["open"] & (acc["used"] + x["cost"] <= most))
            return F.struct((acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), (acc["open"] & (F.lit(skip) | fits)).alias("open"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

        return F.aggregate(source, start, step)["kept"]

    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "doc_id", "cost"))).alias("p"), F.sum("cost").alias("total"))
    chosen = g.select("query_id", F.when(F.col("total") > most, fold(F.col("p"), True)).otherwise(F.col("p")).alias("c"))
    ordered = F.transform(F.array_sort(F.transform("c", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["neg"].alias("neg"), x["cost"].alias("cost")))), lambda x: F.struct(x["neg"].alias("neg"), x["doc_id"].alias("doc_id"), x["cost"].alias("cost")))
    return chosen.select("query_id", F.posexplode(fold(ordered, False)).alias("place", "x")).select("query_id", F.col("x.doc_id").alias("doc_id"), "place")


def chosen_until(passages: DataFrame, budget: int, most: int | None = None) -> DataFrame:
    """query_id, doc_id, used: passages by score until one doesn't fit the budget (the first always stays) or there are `most`.

    passages: query_id, doc_id, score, words; a passage costs its tokens and a header.
    """
    cost = F.greatest(F.lit(1), F.floor(F.col("words") * WORDS_TO_TOKENS)).cast("long") + HEADER_TOKENS
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = passages.withColumn("cost", cost).withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(((F.col("used") <= budget) | (F.col("rank") == 1)) & (F.lit(True) if most is None else F.col("rank") <= most))
    return rows.select("query_id", "doc_id", "used")


def budget_split(total: Column, briefing_tokens: Column, share: float = 0.25) -> Column:
    """struct(briefing, passages): a quarter for the briefing, and for the passages what it leaves of the total; ten tokens each at least."""
    return F.struct(F.greatest(F.lit(10), F.floor(total * share)).cast("long").alias("briefing"), F.greatest(F.lit(10), total - F.least(briefing_tokens, F.floor(total * share))).cast("long").alias("passages"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a code in their text, and benchmark items that ask for one, for a name of two words and for their own."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.format_string(" Ref AB-%d of Anna Bell%d.", F.col("doc_id") % 37, F.col("doc_id") % 11)).alias("text"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.regexp_replace(F.lower("text"), r"[^a-z ]", " "), F.format_string(" AB-%d ", F.col("item_id") % 37), F.when(F.col("item_id") % 2 == 0, F.format_string("Anna Bell%d", F.col("item_id") % 11)).otherwise("")).alias("text"))
    return d, q


def q_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every item by BM25 and entities."""
    return retrieval.top_k(tiered(*_inputs(spark, sf_dir)), 10)


def q_keep_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every item that its keep policy leaves, at least half of the best score or with its code."""
    d, q = _inputs(spark, sf_dir)
    # written, as the policy reads them twice
    units = cut(tiered_scaled(d, q, 0.5).join(spread(d).select("doc_id", token_estimate(F.col("text")).alias("tokens")), "doc_id"), "units")
    return keep_units(units, threshold=0.5, most=6, budget=1000)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    known = v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieval.cosine_scores(known, asked).withColumnRenamed("vec_id", "doc_id")


def q_fused_exact(spark: SparkSession, sf_dir: str, bypass: float | None = None) -> DataFrame:
    """Lexical and dense ranks fused, for documents that have a vector; exact identifiers lead.  With a bypass only the queries of even id have identifiers."""
    lexical = tiered(*_inputs(spark, sf_dir), among=table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))
    if bypass is not None:
        lexical = lexical.withColumn("exact", F.col("exact") & (F.col("query_id") % 2 == 0))
    return fused(lexical, _dense(spark, sf_dir), 5, bypass=bypass)


def q_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 lists whose better half is scored again by the share of the document's length; counted by stage."""
    d, q = _inputs(spark, sf_dir)
    length = d.select("doc_id", F.round(F.lit(1000.0) / (1000 + F.char_length("text")), 6).alias("again"))
    # scores lie by document, so the lengths join them there; what is written is read by all steps
    rows = cut(tiered(d, q).join(length, "doc_id").select("query_id", "doc_id", "score", "again"), "scores")
    return retrieval.top_k(cascade(scaled(rows), lambda c: c.select("query_id", "doc_id", F.col("again").alias("score"))), 12)


def q_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of every item by the coverage of its best document and its best cosine."""
    docs, queries = retrieval._inputs(spark, sf_dir)
    best = retrieval.top_k(retrieval.bm25(docs, queries), 1).select("query_id", "doc_id").join(docs.withColumnRenamed("text", "context"), "doc_id").join(queries, "query_id")
    dense = _dense(spark, sf_dir).groupBy("query_id").agg(F.max("score").alias("dense"))
    c = retrieval.coverage(best).join(dense, "query_id", "left")
    r = route(F.col("coverage"), F.col("dense"), hot=0.4)
    return c.select("query_id", r["mode"].alias("mode"), r["coverage"].alias("coverage"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = retrieval._inputs(spark, sf_dir)
    best = retrieval.top_k(retrieval.bm25(docs, queries), 30).select("query_id", "doc_id", "score")
    return best.join(docs.select("doc_id", word_count(F.coalesce("text", F.lit(""))).cast("long").alias("words")), "doc_id")


def q_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every item's context of 1,500 tokens."""
    return packed(_passages(spark, sf_dir), 1500)


def q_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense baseline: passages by cosine until 1,200 tokens or four of them."""
    words = table(spark, sf_dir, "documents").select("doc_id", word_count(F.coalesce("text", F.lit(""))).cast("long").alias("words"))
    return chosen_until(_dense(spark, sf_dir).join(words, "doc_id"), 1200, 4)


def q_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the parts of the orders whose key is divisible by 50: the five with most parts in common."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.col("l_partkey") % 100).alias("codes"))
    asked = li.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return best_by_concepts(li, asked, 5)


def q_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of conversations whose first turn is their briefing."""
    c = table(spark, sf_dir, "conversations").withColumn("t", token_estimate(F.coalesce("text", F.lit(""))))
    g = c.groupBy("conv_id").agg(F.sum("t").alias("total"), F.coalesce(F.sum(F.when(F.col("turn") == 0, F.col("t"))), F.lit(0)).alias("first"))
    s = budget_split(F.col("total"), F.col("first"))
    return g.select("conv_id", "total", s["briefing"].alias("briefing"), s["passages"].alias("passages"))


QUERIES = {
    "bm25_entity_tiers": q_tiers, "keep_exact_id": q_keep_exact, "rrf_exact_id": q_fused_exact, "rrf_bypass_rank": lambda s, d: q_fused_exact(s, d, 0.4), "cascade_rerank": q_cascade, "mode_routes": q_routes,
    "passage_packing": q_packed, "dense_rag_baseline": q_rag, "concept_overlap": q_concepts, "context_budgets": q_budgets,
}
_T = "regexp_extract_all(lower({0}), '[a-z0-9_]{{2,}}')"
#: An item's entities: its code, and for even ones the two-word name and that name's words; the other words stand in lower case and count only where fewer than three are named.
_ITEMS = """q AS (SELECT item_id AS query_id, regexp_replace(lower(text), '[^a-z ]', ' ', 'g') || ' AB-' || (item_id % 37) || ' ' || CASE WHEN item_id % 2 = 0 THEN 'Anna Bell' || (item_id % 11) ELSE '' END AS text FROM benchmark),
d AS (SELECT doc_id, coalesce(text, '') || ' Ref AB-' || (doc_id % 37) || ' of Anna Bell' || (doc_id % 11) || '.' AS text FROM documents)"""
_STOP = retrieval._STOP
_BM = retrieval._BM25.replace("FROM benchmark", "FROM q").replace("item_id AS query_id", "query_id").replace("FROM documents", "FROM d")
_HITS = f"""w0 AS (SELECT query_id, list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS w, query_id % 2 = 0 AS even FROM q),
cap AS (SELECT query_id, list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 2 AND lower(x) NOT IN {_STOP}) AS c, list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND lower(x) NOT IN {_STOP}) AS a, even FROM w0),
en AS (SELECT query_id, lower(unnest(c)) AS e FROM cap UNION SELECT query_id, lower(unnest(a)) FROM cap WHERE (SELECT count(DISTINCT lower(x)) FROM (SELECT unnest(c) AS x)) < 3 UNION SELECT query_id, 'ab-' || (query_id % 37) FROM q),
ph AS (SELECT query_id, array_to_string(regexp_extract_all(e, '[a-z0-9_]{{2,}}'), ' ') AS p, min(CASE WHEN regexp_matches(e, '[0-9]') THEN 'id' WHEN contains(e, ' ') THEN 'phrase' ELSE 'word' END) AS tier FROM en GROUP BY ALL),
dd AS (SELECT doc_id, ' ' || array_to_string({_T.format('text')}, ' ') || ' ' AS t FROM d),
hit AS (SELECT query_id, doc_id, sum(CASE tier WHEN 'id' THEN 8.0 WHEN 'phrase' THEN 6.0 ELSE 4.0 END) AS bonus, bool_or(tier = 'id') AS exact FROM ph JOIN dd ON contains(t, ' ' || p || ' ') WHERE p <> '' GROUP BY ALL),
ti AS (SELECT query_id, doc_id, CAST(CASE WHEN bonus > 0 THEN round((CAST(coalesce(score, 0.0) AS DECIMAL(18,6)) + CAST(bonus AS DECIMAL(18,6))) * CASE WHEN exact THEN 2.0 ELSE 1.5 END, 6) ELSE score END AS DOUBLE) AS score, coalesce(exact, false) AS exact FROM bm FULL JOIN hit USING (query_id, doc_id)),
sc AS (SELECT query_id, doc_id, exact, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) ELSE 0.0 END AS score FROM ti WINDOW w AS (PARTITION BY query_id))"""
_ALL = f"{_ITEMS}, {_BM}, {_HITS}"
_DENSE = f"""{retrieval._cos('c', 0, 'vec_id IN (SELECT item_id FROM benchmark)')}, de AS (SELECT query_id, vec_id AS doc_id, score FROM c WHERE vec_id IN (SELECT doc_id FROM documents))"""


def _fused_sql(exact: str) -> str:
    return f"""a AS (SELECT query_id, doc_id, {exact} AS exact, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ti WHERE doc_id IN (SELECT vec_id FROM embeddings)), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM de),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(0.2 / (30 + a.r), 0.0) + coalesce(0.8 / (30 + b.r), 0.0) + CASE WHEN a.exact THEN 1 ELSE 0 END, 8) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f)"""


_WC = "len(list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
ORACLE_SQL = {
    "bm25_entity_tiers": f"WITH {_ALL} {retrieval._top('ti', 10)}",
    "keep_exact_id": f"""WITH RECURSIVE {_ALL}, u AS (SELECT query_id, sc.doc_id, score, exact, CAST(floor({_WC.format('text')} * 1.33) AS BIGINT) AS tokens FROM sc JOIN d ON d.doc_id = sc.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, doc_id) AS rank FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE (exact OR score >= 0.5 OR rank = 1) AND (exact OR rank <= 6)),
f AS (SELECT query_id, doc_id, score, tokens, exact, n, tokens AS used, true AS kept FROM k WHERE n = 1 UNION ALL SELECT k.query_id, k.doc_id, k.score, k.tokens, k.exact, k.n, CASE WHEN f.used + k.tokens <= CASE WHEN k.exact THEN 3500 ELSE 1000 END THEN f.used + k.tokens ELSE f.used END, f.used + k.tokens <= CASE WHEN k.exact THEN 3500 ELSE 1000 END FROM f JOIN k ON k.query_id = f.query_id AND k.n = f.n + 1)
SELECT query_id, doc_id, score, tokens, exact FROM f WHERE kept""",
    "rrf_exact_id": f"WITH {_ALL}, {_DENSE}, {_fused_sql('exact')} SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM g WHERE place <= 5",
    "rrf_bypass_rank": f"""WITH {_ALL}, {_DENSE}, {_fused_sql('exact AND query_id % 2 = 0')}, h AS (SELECT query_id FROM de GROUP BY query_id HAVING max(score) >= 0.4 EXCEPT SELECT query_id FROM a WHERE exact),
z AS (SELECT query_id, doc_id, score, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM de WHERE query_id IN (SELECT query_id FROM h)) SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM g WHERE place <= 5 AND query_id NOT IN (SELECT query_id FROM h) UNION ALL SELECT query_id, doc_id, score, CAST(place AS INTEGER) FROM z WHERE place <= 5""",
    "cascade_rerank": f"""WITH {_ALL}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk, count(*) OVER (PARTITION BY query_id) AS n FROM sc),
x AS (SELECT r.query_id, r.doc_id, CASE WHEN rk <= greatest(2, least(n, greatest(n // 2, 6))) THEN round(1000.0 / (1000 + length(text)), 6) ELSE round(score * 0.1, 6) END AS score, CASE WHEN rk <= greatest(2, least(n, greatest(n // 2, 6))) THEN 2 ELSE 1 END AS stage FROM r JOIN d ON d.doc_id = r.doc_id) {retrieval._top('x', 12)}""",
    "mode_routes": retrieval.ORACLE_SQL["coverage_score"].replace("SELECT *, CASE WHEN coverage >= 0.75 THEN 'raw' ELSE 'hot' END AS mode FROM s", f"SELECT s.query_id, CASE WHEN m >= 0.4 OR coverage >= 0.75 THEN 'raw' ELSE 'hot' END AS mode, CASE WHEN m >= 0.4 THEN 1.0 ELSE coverage END AS coverage FROM s LEFT JOIN (WITH {_DENSE} SELECT query_id, max(score) AS m FROM de GROUP BY query_id) x ON x.query_id = s.query_id"),
    "passage_packing": f"""WITH RECURSIVE {retrieval._BM25}, top AS ({retrieval._top('bm', 30)}), p AS (SELECT query_id, top.doc_id, score, {_WC.format("coalesce(text, '')")} + 15 AS cost FROM top JOIN documents USING (doc_id) WHERE {_WC.format("coalesce(text, '')")} > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n, sum(cost) OVER (PARTITION BY query_id) AS total FROM p),
f AS (SELECT query_id, doc_id, cost, total, n, cost AS used, true AS kept FROM o WHERE n = 1 UNION ALL SELECT o.query_id, o.doc_id, o.cost, o.total, o.n, CASE WHEN f.used + o.cost <= 1127 OR o.total <= 1127 THEN f.used + o.cost ELSE f.used END, f.used + o.cost <= 1127 OR o.total <= 1127 FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1),
c AS (SELECT query_id, doc_id, sum(cost) OVER (PARTITION BY query_id ORDER BY doc_id) AS used, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS place FROM f WHERE kept) SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM c WHERE place = 0 OR used <= 1127""",
    "dense_rag_baseline": f"""WITH {_DENSE}, p AS (SELECT query_id, doc_id, score, greatest(1, CAST(floor({_WC.format("coalesce(text, '')")} * 1.33) AS BIGINT)) + 10 AS cost FROM de JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER w AS rk, sum(cost) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id))
SELECT query_id, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE (used <= 1200 OR rk = 1) AND rk <= 4""",
    "concept_overlap": f"""WITH k AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 100 AS c FROM lineitem), n AS (SELECT o, count(*) AS n FROM k GROUP BY o), m AS (SELECT q.o AS query_id, x.o AS doc_id, round(count(*) / max(n), 6) AS score FROM k q JOIN k x ON q.c = x.c AND q.o <> x.o JOIN n ON n.o = q.o WHERE q.o % 50 = 0 GROUP BY ALL) {retrieval._top('m', 5)}""",
    "context_budgets": f"""WITH c AS (SELECT conv_id, turn, CAST(floor({_WC.format("coalesce(text, '')")} * 1.33) AS BIGINT) AS t FROM conversations), g AS (SELECT conv_id, CAST(sum(t) AS BIGINT) AS total, CAST(coalesce(sum(t) FILTER (turn = 0), 0) AS BIGINT) AS first FROM c GROUP BY conv_id)
SELECT conv_id, total, greatest(10, CAST(floor(total * 0.25) AS BIGINT)) AS briefing, greatest(10, total - least(first, CAST(floor(total * 0.25) AS BIGINT))) AS passages FROM g""",
}
