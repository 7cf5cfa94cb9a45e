"""Similar names: an exact join on the cosine of character trigram sets, by prefixes of rare grams.

Two sets of cosine t or more share at least t² of the grams of each, so one of the rarest n - ceil(t² n) + 1 grams of either side is among them: names meet
on those grams only, and what meets is checked in full. Cyrillic letters are written in Latin ones first, so that names meet across scripts.

Defined results: null names and names without a gram meet nothing; a name that comes several times counts once; a name is not similar to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.quality import cross_script, lemma_key
from kiln.session import cut

# Cyrillic letters in Latin ones, letter by letter.
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))


def latin(text: Column) -> Column:
    """Lower case with Cyrillic letters in Latin ones."""
    out = F.lower(text)
    for a, b in LATIN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def grams(name: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of the Latin form between two blanks."""
    t = F.concat(F.lit(" "), latin(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n))))


def _indexed(names: DataFrame, weights: DataFrame, threshold: float, side: str) -> DataFrame:
    """(side, its grams, gram): a row for each gram of the prefix of a name."""
    each = names.select(F.col("name").alias(side), F.col("grams").alias(f"g_{side}"), F.explode("grams").alias("gram"))
    order = Window.partitionBy(side).orderBy(F.coalesce("df", F.lit(0)), "gram")
    n = F.size(f"g_{side}")
    prefix = n - F.ceil(n * threshold * threshold - 1e-9) + 1
    return each.join(weights, "gram", "left").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= prefix).drop("k", "df")


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): names of left (column name) with the names of right of cosine threshold or more, equal names left out."""
    x, y = (cut(d.filter("name is not null").select("name").distinct().withColumn("grams", grams(F.col("name")))) for d in (left, right))
    # One order of the grams for both sides: by how many names hold them.
    df = x.unionByName(y).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    met = _indexed(x, df, threshold, "a").join(_indexed(y, df, threshold, "b"), "gram").filter("a <> b").select("a", "b", "g_a", "g_b").distinct()
    score = F.size(F.array_intersect("g_a", "g_b")) / F.sqrt(F.size("g_a") * F.size("g_b").cast("double"))
    return met.select("a", "b", F.round(score, 6).alias("score")).filter(F.col("score") >= threshold)


def coreferent(names: DataFrame, same: float = 0.92, cross: float = 0.85) -> DataFrame:
    """(a, b, score, cross): pairs a < b of names with different lemma keys that may mean one thing: same or more within a script, cross or more across scripts."""
    pairs = similar(names, names, min(same, cross)).filter("a < b").withColumn("cross", cross_script(F.col("a"), F.col("b")))
    pairs = pairs.filter(lemma_key(F.col("a")) != lemma_key(F.col("b")))
    return pairs.filter(F.when(F.col("cross"), F.col("score") >= cross).otherwise(F.col("score") >= same))


def sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_pairs, n_names): pairs (a, b, score) at or above each threshold, and the names in them."""
    each = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter("score >= threshold")
    n = each.groupBy("threshold").agg(F.count("*").alias("n_pairs"))
    ends = each.select("threshold", F.explode(F.array("a", "b")).alias("name")).groupBy("threshold").agg(F.countDistinct("name").alias("n_names"))
    every = pairs.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    return every.join(n, "threshold", "left").join(ends, "threshold", "left").na.fill(0)


def coverage(terms: DataFrame, names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(term, lexical, similar): whether a term (column term) stands within a name, and whether it does or a name is similar to it: the exact and the semantic side of completeness."""
    from kiln.operators.quality import contained_terms

    lexical = contained_terms(terms, names).withColumnRenamed("covered", "lexical")
    near = similar(terms.select(F.col("term").alias("name")), names, threshold).select(F.col("a").alias("term"), F.lit(True).alias("near")).distinct()
    return lexical.join(near, "term", "left").select("term", "lexical", (F.col("lexical") | F.coalesce("near", F.lit(False))).alias("similar"))
