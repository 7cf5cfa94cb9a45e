"""Vectors: TF-IDF, cosine search of a query set against all rows, weighted concatenation, neighbourhood encoders, link prediction.

Defined results: null vectors are left out; a zero vector has cosine 0 to everything; ties go to the smaller id. Query vectors are held in blocks of
BLOCK rows; each block is multiplied with every partition of the corpus, so neither side is shuffled for the products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def weighted_concat(parts: list[tuple[Column, float]]) -> Column:
    """Parts scaled by the root of their weight, so that a dot product is the weighted sum of the parts' dot products."""

    def scaled(c: Column, w: float) -> Column:
        return F.transform(c, lambda x: x.cast("double") * F.lit(w**0.5))

    return F.concat(*[scaled(c, w) for c, w in parts])


def tfidf(docs: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, term, tfidf): raw counts, idf = ln((1 + n) / (1 + df)) + 1, rows of length 1. docs: key and an array of words."""
    tf = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(key).distinct().count()
    w = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("tfidf"))


def scored(queries: DataFrame, corpus: DataFrame, key: str, vector: str, keep, columns: str) -> DataFrame:
    """keep(ids of a block, matrix of cosines, ids of a corpus batch) gives rows of columns; blocks of queries come from the driver one after another."""
    out = None
    rows = queries.select(key, vector).filter(F.col(vector).isNotNull()).orderBy(key)

    def block(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        held = corpus.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for b in batches:
                if len(b):
                    m = np.stack(b[vector].to_numpy()).astype(np.float64)
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    yield keep(ids, q @ (m / np.where(n > 0, n, 1)).T, b[key].to_numpy())

        return corpus.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(run, columns)

    ids, vecs = [], []

    def flush() -> None:
        nonlocal out, ids, vecs
        q = np.array(vecs, np.float64)
        n = np.linalg.norm(q, axis=1, keepdims=True)
        part = block(np.array(ids), q / np.where(n > 0, n, 1))
        out, ids, vecs = part if out is None else out.unionByName(part), [], []

    for r in rows.toLocalIterator():
        ids.append(r[0])
        vecs.append(r[1])
        if len(ids) == BLOCK:
            flush()
    if ids:
        flush()
    return out if out is not None else corpus.sparkSession.createDataFrame([], columns)


def topk(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", others: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows of each query by cosine; each batch keeps its own k, a window the k over all. others: not the query itself."""

    def keep(ids: np.ndarray, s: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        if others:
            s = np.where(ids[:, None] == keys[None, :], -np.inf, s)
        # All rows that share the k-th score stay, so that the order by id decides among them over all batches.
        s = np.round(s, 6)
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        return pd.DataFrame({"query_id": ids[i], key: keys[j], "score": s[i, j]})

    kind = dict(corpus.dtypes)[key]
    found = scored(queries, corpus, key, vector, keep, f"query_id {kind}, {key} {kind}, score double")
    ranked = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.filter(F.col("rank") <= k)


def within(queries: DataFrame, corpus: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score) of all rows of a cosine of threshold or more to a query, but for the query itself."""

    def keep(ids: np.ndarray, s: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero((s >= threshold) & (ids[:, None] != keys[None, :]))
        return pd.DataFrame({"query_id": ids[i], key: keys[j], "score": s[i, j]})

    kind = dict(corpus.dtypes)[key]
    return scored(queries, corpus, key, vector, keep, f"query_id {kind}, {key} {kind}, score double")


def mean_neighbours(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, x): per vertex the element-wise mean of its neighbours' features (name, x array<double>); without neighbours, zeros. By position, so vectors never meet in one task."""
    f = features.select(F.col("name").alias("dst"), F.posexplode("x").alias("i", "v"))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    m = both.join(f, "dst").groupBy("src", "i").agg(F.avg("v").alias("v")).groupBy(F.col("src").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("m"))
    return features.join(m, "name", "left").select("name", F.coalesce("m", F.transform("x", lambda _: F.lit(0.0))).alias("x"))


def sage(features: DataFrame, edges: DataFrame, layers: int = 2, seed: int = 5) -> DataFrame:
    """(name, x): layers of relu(own * w + mean of neighbours * u) with seeded weights per position, to unit length: an untrained encoder of neighbourhoods."""
    dim = len(features.first().x)
    rnd = np.random.default_rng(seed)
    out = features
    for _ in range(layers):
        w, u = rnd.uniform(0.5, 1.5, dim).tolist(), rnd.uniform(0.5, 1.5, dim).tolist()
        near = mean_neighbours(out, edges).withColumnRenamed("x", "m")
        x = F.transform(F.zip_with("x", "m", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p, i: p["a"] * F.get(F.array(*map(F.lit, w)), i) + p["b"] * F.get(F.array(*map(F.lit, u)), i))
        out = out.join(near, "name").select("name", unit(F.transform(x, lambda v: F.greatest(v, F.lit(0.0) * v + v * 0.2))).alias("x"))
    return out


def attention(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, x): neighbours and the vertex itself weighed by a softmax of cosines, one head: the attention form of a layer."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().unionByName(features.select(F.col("name").alias("src"), F.col("name").alias("dst"))).distinct()
    e = both.join(features.select(F.col("name").alias("src"), F.col("x").alias("a")), "src").join(features.select(F.col("name").alias("dst"), F.col("x").alias("b")), "dst").withColumn("s", F.exp(cosine(F.col("a"), F.col("b"))))
    total = e.groupBy("src").agg(F.sum("s").alias("z"))
    v = e.join(total, "src").select("src", (F.col("s") / F.col("z")).alias("w"), F.posexplode("b").alias("i", "v")).groupBy("src", "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return v.groupBy(F.col("src").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("x"))


def link_split(edges: DataFrame, seed: int = 7) -> DataFrame:
    """edges with column part: train (80 %), valid, test (10 % each), by a seeded hash of the ends."""
    h = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(100))
    return edges.select("src", "dst").withColumn("part", F.when(h < 80, "train").when(h < 90, "valid").otherwise("test"))


def negatives(edges: DataFrame, vertices: DataFrame, seed: int = 11) -> DataFrame:
    """(src, dst): for each edge a drawn vertex for its end: names lie in as many hash buckets as there are names, an edge draws a bucket and takes its smallest name; empty draws, known edges and loops are left out."""
    n = vertices.select("name").distinct()
    size = max(n.count(), 1)
    numbered = n.groupBy(F.pmod(F.xxhash64("name"), F.lit(size)).alias("at")).agg(F.min("name").alias("dst"))
    drawn = edges.select("src", F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(size)).alias("at")).join(numbered, "at").select("src", "dst").filter("src <> dst")
    known = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return drawn.distinct().join(known, ["src", "dst"], "left_anti")


def link_scores(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs (src, dst, label) with score: ten times the cosine of the ends' vectors."""
    return pairs.join(features.select(F.col("name").alias("src"), F.col("x").alias("a")), "src").join(features.select(F.col("name").alias("dst"), F.col("x").alias("b")), "dst").withColumn("score", 10 * cosine(F.col("a"), F.col("b"))).drop("a", "b")
