"""Queries on vectors and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators import chunking as K
from kiln.operators import evaluation as E
from kiln.operators import graph as G
from kiln.operators import vectors as V
from kiln.plans import graph as GP
from kiln.plans.base import Tables, query

TFIDF = r"""
WITH d AS (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1), w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM d),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT chunk_id)::DOUBLE AS n FROM w),
x AS (SELECT chunk_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), s AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1)
"""


def words(t: Tables) -> DataFrame:
    d = t.chunks.groupBy("chunk_id").agg(F.min("text").alias("text"))
    return d.select("chunk_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("words")).filter("size(words) > 0")


@query(TFIDF + "SELECT chunk_id, term, round(w / norm, 6) AS tfidf FROM x JOIN s USING (chunk_id)")
def tfidf(t: Tables) -> DataFrame:
    return V.tfidf(words(t), "chunk_id").withColumn("tfidf", F.round("tfidf", 6))


@query(TFIDF + "SELECT count(*) AS n_entries, count(DISTINCT term) AS vocabulary, count(DISTINCT chunk_id) AS n_docs, round(count(*) / (count(DISTINCT term) * count(DISTINCT chunk_id))::DOUBLE, 8) AS filled FROM x")
def tfidf_sparsity(t: Tables) -> DataFrame:
    d = V.tfidf(words(t), "chunk_id")
    return d.agg(F.count("*").alias("n_entries"), F.countDistinct("term").alias("vocabulary"), F.countDistinct("chunk_id").alias("n_docs"), F.round(F.count("*") / (F.countDistinct("term") * F.countDistinct("chunk_id")), 8).alias("filled"))


COS = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))"
ALL = f"(SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label AS el, round({COS}, 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)"


def query_set(t: Tables) -> DataFrame:
    """Every row whose id is divisible by 50."""
    return t.embeddings.filter("vec_id % 50 = 0")


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM {ALL}) WHERE rank <= 5")
def cosine_topk(t: Tables) -> DataFrame:
    return V.topk(query_set(t), t.embeddings, 5)


@query(f"SELECT query_id, vec_id, score FROM {ALL} WHERE score >= 0.3")
def cosine_threshold(t: Tables) -> DataFrame:
    return V.within(query_set(t), t.embeddings, 0.2999995).withColumn("score", F.round("score", 6)).filter("score >= 0.3")


@query(f"SELECT t AS threshold, count(score) FILTER (score >= t) AS n_pairs, count(DISTINCT query_id) FILTER (score >= t) AS n_queries FROM {ALL}, (SELECT unnest([0.5, 0.45, 0.42, 0.4, 0.38, 0.35, 0.3]::DOUBLE[]) AS t) GROUP BY t")
def threshold_sweep(t: Tables) -> DataFrame:
    """Pairs once at the lowest threshold, then counted at each."""
    sweep = [0.5, 0.45, 0.42, 0.4, 0.38, 0.35, 0.3]
    pairs = V.within(query_set(t), t.embeddings, min(sweep) - 5e-7).withColumn("score", F.round("score", 6))
    each = pairs.select("query_id", "score", F.explode(F.array(*map(F.lit, sweep))).alias("threshold")).filter("score >= threshold").groupBy("threshold").agg(F.count("*").alias("n_pairs"), F.countDistinct("query_id").alias("n_queries"))
    return t.spark.createDataFrame([(x,) for x in sweep], "threshold double").join(each, "threshold", "left").na.fill(0)


@query(f"SELECT query_id, max(score) FILTER (ql = el) AS best_same, max(score) FILTER (ql <> el) AS best_other FROM {ALL} GROUP BY 1")
def cross_group_best(t: Tables) -> DataFrame:
    labels = t.embeddings.select("vec_id", "label")
    pairs = V.within(query_set(t), t.embeddings, -1.1).withColumn("score", F.round("score", 6)).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return pairs.groupBy("query_id").agg(F.max(F.when(F.col("ql") == F.col("label"), F.col("score"))).alias("best_same"), F.max(F.when(F.col("ql") != F.col("label"), F.col("score"))).alias("best_other"))


HYB = "list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query(f"SELECT vec_id, round(0.3 * {HYB} + 0.7 * {HYB}, 5) AS self_dot, (2 * len(embedding))::INT AS dims FROM embeddings e")
def hybrid_score(t: Tables) -> DataFrame:
    both = t.embeddings.select("vec_id", V.weighted_concat([(F.col("embedding"), 0.3), (F.col("embedding"), 0.7)]).alias("h"))
    return both.select("vec_id", F.round(F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x), 5).alias("self_dot"), F.size("h").alias("dims"))


@query("""
SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first_mean, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS least_norm FROM embeddings GROUP BY label
""")
def vector_norms(t: Tables) -> DataFrame:
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first_mean"), F.round(F.min(n), 4).alias("least_norm"))


def hashed(names: DataFrame) -> DataFrame:
    """(name, x): eight hashed counts of character pairs of each name."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substr("name", i, F.lit(2))), F.lit(8)))
    return names.select("name", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double")).alias("x")).withColumn("x", V.unit(F.col("x")))


def features(t: Tables) -> DataFrame:
    """hashed() of the vertices."""
    return hashed(GP.names(t))


@query()
def sage_embedding(t: Tables) -> DataFrame:
    return V.sage(features(t), GP.edges(t)).select("name", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query()
def attention_embedding(t: Tables) -> DataFrame:
    return V.attention(features(t), GP.edges(t)).select("name", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query()
def link_prediction(t: Tables) -> DataFrame:
    e = GP.edges(t).filter("src <> dst")
    split = V.link_split(e)
    known = split.filter("part = 'train'")
    x = V.sage(features(t), known)
    test = split.filter("part <> 'train'").select("src", "dst").withColumn("label", F.lit(True)).unionByName(V.negatives(e, GP.names(t)).withColumn("label", F.lit(False))).withColumn("arm", F.lit("names"))
    s = V.link_scores(test, x)
    return E.roc_auc(s, ["arm"]).join(E.average_precision(s, ["arm"]), "arm")
