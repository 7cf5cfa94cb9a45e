"""Evaluation: ranking measures, agreement of judges, error rates, comparison of variants.

Defined results: a measure over nothing is null unless its docstring says otherwise; ties in scores share the mean rank in roc_auc and go to the smaller id in rankings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(hits: DataFrame, query: str, ks: tuple[int, ...] = (1, 3, 5), depth: int = 10) -> DataFrame:
    """(query, first_rank, hit@k, rr, ndcg) from (query, rank, relevant): binary gain, the ideal ranking holds min(relevant rows, depth). A query without relevant rows has null first_rank and zeros."""
    gain = F.when(F.col("relevant") & (F.col("rank") <= depth), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    g = hits.groupBy(query).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.sum(gain).alias("dcg"), F.count_if("relevant").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", F.lit(depth)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    hit = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int").alias(f"hit_{k}") for k in ks]
    return g.select(query, "first_rank", *hit, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def precision_recall(rows: DataFrame, got: str, wanted: str) -> list[Column]:
    """Share of got that is wanted, and of wanted that is got, for two array columns; null where undefined."""
    both = F.size(F.array_intersect(got, wanted))
    return [(both / F.nullif(F.size(F.array_distinct(F.col(got))), F.lit(0))).alias("precision"), (both / F.nullif(F.size(F.array_distinct(F.col(wanted))), F.lit(0))).alias("recall")]


def kappa(pairs: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, n, agree, kappa) of two boolean ratings; kappa is 1 where chance agreement is 1."""
    s = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.count_if(a).alias("x"), F.count_if(b).alias("y"))
    n = F.col("n").cast("double")
    expected = (F.col("x") * F.col("y") + (n - F.col("x")) * (n - F.col("y"))) / (n * n)
    agree = F.col("same") / n
    return s.select(*group, "n", agree.alias("agree"), F.when(expected == 1, 1.0).otherwise((agree - expected) / (1 - expected)).alias("kappa"))


def roc_auc(rows: DataFrame, group: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(group, n_pos, n_neg, auc): rank-sum over counts per score, so that a group is never sorted row by row; null without both labels."""
    per = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*group, F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    w = Window.partitionBy(*group).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = per.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    s = below.groupBy(*group).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)).alias("u"))
    return s.select(*group, "n_pos", "n_neg", (F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def average_precision(rows: DataFrame, group: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(group, ap): precision at each distinct score times the recall it adds."""
    per = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*group, F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = per.withColumn("cp", F.sum("p").over(w)).withColumn("cn", F.sum("n").over(w))
    s = c.groupBy(*group).agg(F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("a"), F.sum("p").alias("all"))
    return s.select(*group, (F.col("a") / F.nullif(F.col("all"), F.lit(0))).alias("ap"))


def cer(truth: Column, text: Column) -> Column:
    """Character error rate: edit distance over the length of the truth."""
    return F.levenshtein(text, truth) / F.nullif(F.length(truth), F.lit(0))


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def wer(pairs: DataFrame, key: str, truth: str, text: str) -> DataFrame:
    """(key, wer): edit distance over words; null for an empty truth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [((t or "").split(), (x or "").split()) for t, x in zip(b["_a"], b["_b"])]
            yield pd.DataFrame({key: b[key], "wer": pd.Series([_distance(t, x) / len(t) if t else None for t, x in rows], dtype=float)})

    return pairs.select(key, F.col(truth).alias("_a"), F.col(text).alias("_b")).mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, wer double")


def block_coverage(pairs: DataFrame, key: str, block: str, text: str, least: int = 4) -> DataFrame:
    """(key, coverage): share of a block's characters in matching stretches of least characters or more with the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            out = []
            for x, y in zip(b["_a"], b["_b"]):
                x, y = x or "", y or ""
                m = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
                out.append(sum(s.size for s in m if s.size >= least) / len(x) if x else None)
            yield pd.DataFrame({key: b[key], "coverage": pd.Series(out, dtype=float)})

    return pairs.select(key, F.col(block).alias("_a"), F.col(text).alias("_b")).mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, coverage double")


def detection(rows: DataFrame, group: list[str], predicted: str, wanted: str, weight: str) -> DataFrame:
    """(group, total, n, tp, fp, fn, precision, recall, f1, weighted_f1): of rows with two booleans, by group and over all; weighted_f1 of the total is the mean of the groups by their weight. Undefined shares are null, an F1 without any case 1."""
    ok = rows.filter(F.col(predicted).isNotNull() & F.col(wanted).isNotNull())
    p, w = F.col(predicted), F.col(wanted)
    s = ok.rollup(*group).agg(F.grouping(group[0]).cast("int").alias("total"), F.count("*").alias("n"), F.count_if(p & w).alias("tp"), F.count_if(p & ~w).alias("fp"), F.count_if(~p & w).alias("fn"), F.sum(weight).alias("w"))
    div = lambda a, b: a / F.nullif(b, F.lit(0))
    f1 = F.coalesce(div(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(1.0))
    s = s.withColumn("f1", f1)
    mean = s.filter("total = 0").agg((F.sum(F.col("f1") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("weighted_f1"), F.lit(1).alias("total"))
    out = s.join(mean, "total", "left")
    return out.select(*group, "total", "n", "tp", "fp", "fn", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "f1", "weighted_f1")


def variant_report(rows: DataFrame, base: str) -> DataFrame:
    """(metric, variant, kind, base_value, value, delta, noise, clear): each metric of each variant beside the base. rows: (variant, repeat, metric, kind, value) of repeated runs; values are means over repeats, noise is the widest spread that repeats of one variant show."""
    per = rows.filter("value is not null").groupBy("metric", "variant").agg(F.first("kind").alias("kind"), F.avg("value").alias("value"), (F.max("value") - F.min("value")).alias("spread"))
    noise = per.groupBy("metric").agg(F.max("spread").alias("noise"))
    ground = per.filter(F.col("variant") == base).select("metric", F.col("value").alias("base_value"))
    out = per.filter(F.col("variant") != base).join(ground, "metric").join(noise, "metric").withColumn("delta", F.col("value") - F.col("base_value"))
    return out.select("metric", "variant", "kind", "base_value", "value", "delta", "noise", clear_change(F.col("value"), F.col("base_value"), F.col("noise"), F.col("kind")).alias("clear"))


def clear_change(value: Column, base: Column, noise: Column, kind: Column) -> Column:
    """A difference is clear above twice the noise and above its floor: 0.03 for a share, a tenth of the base for a count."""
    floor = F.when(kind == "share", F.lit(0.03)).otherwise(F.abs(base) * 0.1)
    return (F.abs(value - base) > 2 * noise) & (F.abs(value - base) >= floor)
