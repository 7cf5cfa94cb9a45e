"""Consensus of several judges: mean-field variational confusion model over group-bys.

Dirichlet priors on the class shares and on each judge's row of the confusion table; a round takes expected log
probabilities (digamma), the posterior of each pattern of votes, and new counts a judge, until no posterior moves by more than STILL. Items with the same
votes share a pattern, so the rounds run over distinct patterns with their counts: on the driver while their votes are counted to be at most
LOCAL, over joins of votes and parameters beyond that; both follow the same formulas.
A second run by a judge is no other opinion: it counts only where the first is missing.

Defined results: null flags and items without any vote are left out of the fit; an item without votes gets no verdict; repeated rows count once,
of differing rows of an item the latest counts; ties of the posterior at one half are no contradiction. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.session import cut

#: Rounds at most, and the change of a posterior that ends them.
ROUNDS, STILL = 200, 1e-7
#: Pseudo counts: class shares; judge rows as (right, wrong).
CLASS_PRIOR, RIGHT, WRONG = 1.0, 2.0, 1.0
#: Votes of distinct patterns that are held on the driver at most.
LOCAL = 200_000


def digamma(x):
    """Of a number, an array or a Column of positive values: six steps up, then the asymptotic series."""
    out = sum(1 / (x + i) for i in range(6))
    z = x + 6
    y = 1 / (z * z)
    log = F.log(z) if isinstance(z, Column) else np.log(z)
    return log - 0.5 / z - y * (1 / 12 - y * (1 / 120 - y / 252)) - out


def votes(items: DataFrame) -> DataFrame:
    """(item_id, judge, flag): one vote of each judge on each item, runs of one judge merged. items: item_id, judge_flags map, judged_at."""
    latest = items.filter(F.col("judge_flags").isNotNull()).groupBy("item_id").agg(F.max_by("judge_flags", F.struct("judged_at", F.to_json("judge_flags"))).alias("flags"))
    each = latest.select("item_id", F.explode("flags").alias("name", "flag")).filter(F.col("flag").isNotNull())
    run = F.coalesce(F.try_cast(F.regexp_extract("name", r"(?i)[\s_-]*\(?run[\s_-]*(\d+)\)?\s*$", 1), "int") if hasattr(F, "try_cast") else F.expr(r"try_cast(regexp_extract(name, '(?i)[\\s_-]*\\(?run[\\s_-]*(\\d+)\\)?\\s*$', 1) as int)"), F.lit(1))
    each = each.withColumn("run", run).withColumn("judge", F.trim(F.regexp_replace("name", r"(?i)[\s_-]*\(?run[\s_-]*\d+\)?\s*$", "")))
    return each.groupBy("item_id", "judge").agg(F.min_by("flag", F.struct("run", "name")).alias("flag"))


def _patterns(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item_id, v), (v, n)): the votes of each item in order, and the distinct patterns of votes with their counts."""
    by_item = cut(votes(items).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("judge", "flag"))).alias("v")))
    return by_item, cut(by_item.groupBy("v").agg(F.count("*").cast("double").alias("n")))


def fit(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((item_id, v), (v, p), (judge, t1, f1, t0, f0)): item votes, posterior of class true of each pattern, posterior counts of each judge."""
    by_item, patterns = _patterns(items)
    size = patterns.agg(F.sum(F.size("v"))).first()[0] or 0
    posterior, counts = _local(patterns) if size <= LOCAL else _joined(patterns)
    return by_item, posterior, counts


def _local(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds over arrays: pattern and judge of each vote."""
    rows = patterns.orderBy("v").collect()
    spark = patterns.sparkSession
    judges = sorted({x.judge for r in rows for x in r.v})
    at = {j: i for i, j in enumerate(judges)}
    pattern = np.repeat(np.arange(len(rows)), [len(r.v) for r in rows]) if rows else np.zeros(0, int)
    judge = np.array([at[x.judge] for r in rows for x in r.v], int)
    flag = np.array([x.flag for r in rows for x in r.v], bool)
    n = np.array([r.n for r in rows])
    p = np.bincount(pattern, flag, len(rows)) / np.maximum(np.bincount(pattern, minlength=len(rows)), 1) if rows else np.zeros(0)
    t = np.zeros((4, len(judges)))
    for _ in range(ROUNDS if rows else 0):
        for i, (f, w) in enumerate(((True, p), (False, p), (True, 1 - p), (False, 1 - p))):
            t[i] = np.bincount(judge, (n * w)[pattern] * (flag == f), len(judges)) + (RIGHT if i in (0, 3) else WRONG)
        one, zero = (n * p).sum() + CLASS_PRIOR, (n * (1 - p)).sum() + CLASS_PRIOR
        e = [digamma(t[i]) - digamma(t[i // 2 * 2] + t[i // 2 * 2 + 1]) for i in range(4)]
        odds = digamma(one) - digamma(zero) + np.bincount(pattern, np.where(flag, (e[0] - e[2])[judge], (e[1] - e[3])[judge]), len(rows))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, p = np.abs(new - p).max(), new
        if moved < STILL:
            break
    kind = patterns.schema["v"].dataType.simpleString()
    return spark.createDataFrame([(r.v, float(x)) for r, x in zip(rows, p)], f"v {kind}, p double"), spark.createDataFrame([(j, *map(float, t[:, i])) for j, i in at.items()], "judge string, t1 double, f1 double, t0 double, f0 double")


def _joined(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds over tables: votes meet the parameters of their judge, and the posteriors of their pattern. A judge of very many votes is summed before the shuffle."""
    each = cut(patterns.select("v", "n", F.explode("v").alias("x")).select("v", "n", "x.judge", "x.flag"))
    p = cut(patterns.select("v", "n", (F.aggregate("v", F.lit(0.0), lambda a, x: a + F.when(x["flag"], 1.0).otherwise(0.0)) / F.size("v")).alias("p")))
    counts = None
    for _ in range(ROUNDS):
        ways = (("t1", True, F.col("p"), RIGHT), ("f1", False, F.col("p"), WRONG), ("t0", True, 1 - F.col("p"), WRONG), ("f0", False, 1 - F.col("p"), RIGHT))
        counts = cut(each.join(p.select("v", "p"), "v").groupBy("judge").agg(*[(F.sum(F.when(F.col("flag") == f, F.col("n") * w).otherwise(0.0)) + prior).alias(c) for c, f, w, prior in ways]))
        s = p.agg(F.sum(F.col("n") * F.col("p")).alias("one"), F.sum(F.col("n") * (1 - F.col("p"))).alias("zero")).first()
        share = float(digamma(s.one + CLASS_PRIOR) - digamma(s.zero + CLASS_PRIOR))
        e = {c: digamma(F.col(c)) - digamma(F.col(c[0].replace("f", "t") + c[1]) + F.col("f" + c[1])) for c in ("t1", "f1", "t0", "f0")}
        weights = counts.select("judge", (e["t1"] - e["t0"]).alias("yes"), (e["f1"] - e["f0"]).alias("no"))
        odds = each.join(weights, "judge").groupBy("v").agg((F.lit(share) + F.sum(F.when(F.col("flag"), F.col("yes")).otherwise(F.col("no")))).alias("odds"))
        new = cut(p.withColumnRenamed("p", "old").join(odds.select("v", (1 / (1 + F.exp(-F.col("odds")))).alias("p")), "v"))
        moved = new.agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0]
        p = new.drop("old")
        if moved is None or moved < STILL:
            break
    return p.select("v", "p"), counts


def verdicts(items: DataFrame) -> DataFrame:
    """(item_id, n_votes, n_yes, p_true, verdict) of each item with votes."""
    by_item, posterior, _ = fit(items)
    rows = by_item.join(posterior.withColumnRenamed("p", "p_true"), "v")
    return rows.select("item_id", F.size("v").alias("n_votes"), F.size(F.filter("v", lambda x: x["flag"])).alias("n_yes"), "p_true").withColumn("verdict", F.col("p_true") > 0.5)


def found(items: DataFrame) -> DataFrame:
    """(item_id) of each item that is contradictory by the joint evidence."""
    return verdicts(items).filter("verdict").select("item_id")


def reliability(items: DataFrame) -> DataFrame:
    """(judge, sensitivity, specificity with the ends of their 95 % intervals, informedness): posterior means of the judges' rows."""
    _, _, counts = fit(items)
    cols: list[Column] = []
    for name, good, bad in (("sensitivity", F.col("t1"), F.col("f1")), ("specificity", F.col("f0"), F.col("t0"))):
        n = good + bad
        sd = F.sqrt(good * bad / (n * n * (n + 1)))
        cols += [(good / n).alias(name), F.greatest(F.lit(0.0), good / n - 1.96 * sd).alias(f"{name}_low"), F.least(F.lit(1.0), good / n + 1.96 * sd).alias(f"{name}_high")]
    return counts.select("judge", *cols).withColumn("informedness", F.col("sensitivity") + F.col("specificity") - 1)


def agreement(items: DataFrame) -> DataFrame:
    """One row: n_items (with two votes or more), n_votes, alpha (Krippendorff, nominal); alpha is null if there is nothing to disagree on."""
    per = votes(items).groupBy("item_id").agg(F.count_if("flag").cast("double").alias("yes"), F.count_if(~F.col("flag")).cast("double").alias("no")).filter("yes + no >= 2")
    s = per.agg(F.count("*").alias("n_items"), F.sum(F.col("yes") + F.col("no")).alias("n"), F.sum("yes").alias("y"), F.sum("no").alias("z"), F.sum(2 * F.col("yes") * F.col("no") / (F.col("yes") + F.col("no") - 1)).alias("pairs"))
    expected = 2 * F.col("y") * F.col("z") / (F.col("n") * (F.col("n") - 1))
    return s.select("n_items", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_votes"), F.when(expected > 0, F.round(1 - F.col("pairs") / F.col("n") / expected, 6)).alias("alpha"))
