"""Evaluation metrics: calibration, significance, regression, scorecards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graphloom.sources.tables import table


def logit(p: Column, eps: float) -> Column:
    clamped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(clamped / (1 - clamped))


def temperature_scaled(p: Column, temperature: float, eps: float = 1e-7) -> Column:
    return 1 / (1 + F.exp(-logit(p, eps) / temperature))


def platt_scaled(p: Column, a: float, b: float, eps: float = 1e-4) -> Column:
    return 1 / (1 + F.exp(-(a * logit(p, eps) + b)))


def truth_of(p: Column, high: float = 0.85, low: float = 0.15) -> Column:
    return F.when(p >= high, "TRUE").when(p <= low, "FALSE").otherwise("UNKNOWN")


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """ece, brier, n: expected calibration error over equal bins (the last closed) and mean squared error."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"), F.sum("n").alias("n"))


def fit_temperature(df: DataFrame, p: str, y: str, low: float = 0.05, high: float = 5.0, steps: int = 40) -> float:
    """The temperature of least mean negative log-likelihood on a geometric grid, found in one pass (one aggregate for each grid point)."""
    grid = [low * (high / low) ** (k / (steps - 1)) for k in range(steps)]
    q = lambda t: F.least(F.greatest(temperature_scaled(F.col(p), t), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = df.agg(*[F.avg(-F.col(y) * F.log(q(t)) - (1 - F.col(y)) * F.log(1 - q(t))).alias(f"t{k}") for k, t in enumerate(grid)]).first()
    return grid[min(range(steps), key=lambda k: loss[k])]


def reconcile(sources: DataFrame, key: str) -> DataFrame:
    """key, truth, confidence of what several sources (truth, p) say: both true and false contradict."""
    t, f = F.col("truth") == "TRUE", F.col("truth") == "FALSE"
    g = sources.groupBy(key).agg(
        F.bool_or(t).alias("t"), F.bool_or(f).alias("f"), F.avg(F.abs(2 * F.col("p") - 1)).alias("c"), F.avg(F.when(t, F.col("p"))).alias("pt"), F.avg(F.when(f, F.col("p"))).alias("pf"), F.avg("p").alias("m")
    )
    truth = F.when(F.col("t") & F.col("f"), "CONTRADICTION").when(F.col("t"), "TRUE").when(F.col("f"), "FALSE").otherwise("UNKNOWN")
    return g.select(key, truth.alias("truth"), F.round(F.when(F.col("t") & F.col("f"), F.col("c")).otherwise(F.coalesce("pt", "pf", "m")), 6).alias("confidence"))


def paired_t(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """group, n, mean_diff, t of paired samples; null t where the differences don't vary."""
    g = df.withColumn("d", F.col(a) - F.col(b)).groupBy(*group).agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return g.select(*group, "n", F.round("m", 6).alias("mean_diff"), F.round(F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))), 4).alias("t"))


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    import math

    if df < 1:
        return 1.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = (1 - x, b, a) if flip else (x, a, b)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
            h *= d * c
    value = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) * h / a
    return 1 - value if flip else value


def regression(df: DataFrame, y: str, x: str, group: list[str]) -> DataFrame:
    """group, slope, intercept, r2, n; null where there are fewer than two points."""
    return df.groupBy(*group).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.count("*").alias("n"))


def macro_f1(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """macro_f1, classes: unweighted mean of the F1 of every gold class."""
    classes = df.select(F.col(gold).alias("c")).distinct()
    tp = df.where(F.col(predicted) == F.col(gold)).groupBy(F.col(gold).alias("c")).agg(F.count("*").alias("tp"))
    n_gold = df.groupBy(F.col(gold).alias("c")).agg(F.count("*").alias("g"))
    n_pred = df.groupBy(F.col(predicted).alias("c")).agg(F.count("*").alias("p"))
    j = classes.join(tp, "c", "left").join(n_gold, "c", "left").join(n_pred, "c", "left").fillna(0, ["tp", "g", "p"])
    return j.agg(F.round(F.avg(2.0 * F.col("tp") / (F.col("g") + F.col("p"))), 6).alias("macro_f1"), F.count("*").alias("classes"))


def bootstrap_means(df: DataFrame, value: str, key: list[str], group: list[str], rounds: int = 200, seed: int = 7) -> DataFrame:
    """group, round, m: means of Poisson resamples; a row's weight follows from its key, the round and the seed, so partitions don't matter."""
    u = (F.pmod(F.xxhash64(*key, F.col("round"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.981, 3).otherwise(4)
    rows = df.select(*{*key, *group, value}).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight)
    return rows.groupBy(*group, "round").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("m"))


def bootstrap_interval(df: DataFrame, value: str, key: list[str], group: list[str], rounds: int = 200, seed: int = 7) -> DataFrame:
    """group, low, high: percentile interval of the mean."""
    return bootstrap_means(df, value, key, group, rounds, seed).groupBy(*group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


@F.pandas_udf(DoubleType())
def _two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([1.0 if pd.isna(x) else student_p(abs(x), int(k) - 1) for x, k in zip(t, n, strict=True)])


def significance(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """group, n, mean_diff, t, p, stars of paired samples; equal samples have p 1.  One row a group reaches the function for p."""
    d = paired_t(df, a, b, group)
    p = F.round(_two_sided(F.col("t"), F.col("n")), 6)
    return d.withColumn("p", F.when(F.col("t").isNull() & (F.col("mean_diff") != 0), 0.0).otherwise(p)).withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def scorecard(rows: DataFrame, suite: str, base: tuple[str, str], treated: tuple[str, str]) -> DataFrame:
    """suite, n, base and treated rates, lift, speed_up: means of (correct, seconds) columns of two runs over the same rows."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    g = rows.groupBy(suite).agg(F.count("*").alias("n"), mean(base[0]).alias("b"), mean(treated[0]).alias("t"), mean(base[1]).alias("bs"), mean(treated[1]).alias("ts"))
    return g.select(suite, "n", F.round("b", 6).alias("base"), F.round("t", 6).alias("treated"), F.round(F.col("t") - F.col("b"), 6).alias("lift"), F.round(F.when(F.col("ts") > 0, F.col("bs") / F.col("ts")), 4).alias("speed_up"))


def losses(df: DataFrame, p: str, y: str, grid: list[float]) -> DataFrame:
    """temperature, loss: mean negative log-likelihood at every temperature of a grid, in one pass."""
    q = lambda t: F.least(F.greatest(temperature_scaled(F.col(p), t), F.lit(1e-7)), F.lit(1 - 1e-7))
    nll = lambda t: F.avg(-F.col(y) * F.log(q(t)) - (1 - F.col(y)) * F.log(1 - q(t)))
    wide = df.agg(*[nll(t).alias(f"t{k}") for k, t in enumerate(grid)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.round(f"t{k}", 6).alias("loss")) for k, t in enumerate(grid)])).alias("x")).select("x.*")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside a score derived from the length of the document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "quality", "toxic", F.round(F.col("n") / (F.col("n") + 800), 6).alias("p"))


def q_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("doc_id", "p", F.round(temperature_scaled(F.col("p"), 1.7), 6).alias("scaled"), F.round(platt_scaled(F.col("p"), 1.2, -0.3), 6).alias("platt"), truth_of(F.col("p")).alias("truth"))


def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as sources: the value as a probability."""
    e = table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") / (F.col("value") + 20), 6).alias("p"))
    return reconcile(e.withColumn("truth", truth_of(F.col("p"))), "user_id")


def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority as suites: finished against not open, with their price and their customer's key as seconds."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderstatus") != "O").alias("b"), "o_totalprice", (F.col("o_custkey") + 1).alias("s"))
    return scorecard(o, "o_orderpriority", ("a", "o_totalprice"), ("b", "s"))


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean discount by return flag; whether they hold the mean of the sample and are narrow."""
    li = table(spark, sf_dir, "lineitem")
    ci = bootstrap_interval(li, "l_discount", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["l_returnflag"], 100)
    m = li.groupBy("l_returnflag").agg(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"), F.count("*").alias("n"))
    wide = (F.col("high") - F.col("low")) / (F.col("s") / F.sqrt("n"))
    return ci.join(m, "l_returnflag").select("l_returnflag", ((F.col("low") <= F.col("m")) & (F.col("m") <= F.col("high"))).alias("holds"), wide.between(2.8, 5.2).alias("sound"))


def q_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the scores at 20 temperatures between 0.05 and 5, and which is least."""
    l = losses(_scored(spark, sf_dir), "p", "quality", [round(0.05 * 100 ** (k / 19), 6) for k in range(20)])  # noqa: E741
    return l.withColumn("best", F.col("loss") == F.min("loss").over(Window.partitionBy()))


QUERIES = {
    "ece_brier": lambda s, d: calibration_error(_scored(s, d), "p", "quality"),
    "belnap_map": q_truth,
    "reconcile_sources": q_reconcile,
    "paired_ttest": lambda s, d: paired_t(table(s, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"]),
    "ols_fit": lambda s, d: regression(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_linestatus"]),
    "suite_scorecard": q_scorecard,
    "paired_significance": lambda s, d: significance(table(s, d, "lineitem").withColumn("y", F.year("l_shipdate")), "l_discount", "l_tax", ["y", "l_linenumber"]),
    "bootstrap_interval": q_bootstrap,
    "temperature_losses": q_temperature,
    "macro_f1": lambda s, d: macro_f1(_scored(s, d).withColumn("predicted", (F.col("p") >= 0.5).cast("int")), "predicted", "quality"),
    "latency_percentiles": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95")),
}
_SC = "s AS (SELECT doc_id, quality, round(n_chars / (n_chars + 800), 6) AS p FROM labels JOIN documents USING (doc_id))"
ORACLE_SQL = {
    "ece_brier": f"WITH {_SC}, g AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(quality) AS acc, sum((p - quality) * (p - quality)) AS sq FROM s GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier, CAST(sum(n) AS BIGINT) AS n FROM g",
    "belnap_map": f"WITH {_SC}, c AS (SELECT doc_id, p, least(greatest(p, 1e-7), 1 - 1e-7) AS a, least(greatest(p, 1e-4), 1 - 1e-4) AS b FROM s) SELECT doc_id, p, round(1 / (1 + exp(-ln(a / (1 - a)) / 1.7)), 6) AS scaled, round(1 / (1 + exp(-(1.2 * ln(b / (1 - b)) - 0.3))), 6) AS platt, CASE WHEN p >= 0.85 THEN 'TRUE' WHEN p <= 0.15 THEN 'FALSE' ELSE 'UNKNOWN' END AS truth FROM c",
    "reconcile_sources": """WITH e AS (SELECT user_id, round(value / (value + 20), 6) AS p FROM events), s AS (SELECT *, p >= 0.85 AS t, p <= 0.15 AS f FROM e)
SELECT user_id, CASE WHEN bool_or(t) AND bool_or(f) THEN 'CONTRADICTION' WHEN bool_or(t) THEN 'TRUE' WHEN bool_or(f) THEN 'FALSE' ELSE 'UNKNOWN' END AS truth,
round(CASE WHEN bool_or(t) AND bool_or(f) THEN avg(abs(2 * p - 1)) ELSE coalesce(avg(p) FILTER (t), avg(p) FILTER (f), avg(p)) END, 6) AS confidence FROM s GROUP BY user_id""",
    "paired_ttest": "SELECT l_returnflag, count(*) AS n, round(avg(l_discount - l_tax), 6) AS mean_diff, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS t FROM lineitem GROUP BY l_returnflag",
    "ols_fit": "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY l_linestatus",
    "suite_scorecard": "SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS base, round(avg(CASE WHEN o_orderstatus <> 'O' THEN 1.0 ELSE 0.0 END), 6) AS treated, round(avg(CASE WHEN o_orderstatus <> 'O' THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS lift, round(avg(o_totalprice) / avg(o_custkey + 1), 4) AS speed_up FROM orders GROUP BY o_orderpriority",
    "bootstrap_interval": "SELECT DISTINCT l_returnflag, true AS holds, true AS sound FROM lineitem",
    "temperature_losses": f"""WITH {_SC}, g AS (SELECT round(0.05 * pow(100, k / 19.0), 6) AS t FROM (SELECT unnest(range(20)) AS k)), q AS (SELECT t, quality AS y, least(greatest(1 / (1 + exp(-ln(least(greatest(p, 1e-7), 1 - 1e-7) / (1 - least(greatest(p, 1e-7), 1 - 1e-7))) / t)), 1e-7), 1 - 1e-7) AS q FROM s, g),
l AS (SELECT t AS temperature, round(avg(-y * ln(q) - (1 - y) * ln(1 - q)), 6) AS loss FROM q GROUP BY t) SELECT *, loss = (SELECT min(loss) FROM l) AS best FROM l""",
    "macro_f1": f"WITH {_SC}, x AS (SELECT CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, quality AS gold FROM s), c AS (SELECT gold AS c FROM x GROUP BY gold) SELECT round(avg(2.0 * (SELECT count(*) FROM x WHERE predicted = c AND gold = c) / ((SELECT count(*) FROM x WHERE gold = c) + (SELECT count(*) FROM x WHERE predicted = c))), 6) AS macro_f1, count(*) AS classes FROM c",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
}
