"""python -m kiln STAGE IN OUT: one stage over the tables of a folder, its result written into a folder."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators import graph as G
from kiln.plans import graph as GP
from kiln.plans import registry
from kiln.plans import stages as plans
from kiln.plans.base import Tables
from kiln.session import clear, local_session
from kiln.sources import files

#: Stage of the pipeline -> the query whose rows it writes as parquet.
STAGES = {
    "prepare": "cut_at_pattern", "clean": "clean_pipeline", "audit": "clean_pipeline_audit", "normalize": "normalize_pipeline", "chunk": "structural_chunks", "tokenize": "typed_tokens", "vectorize": "tfidf", "gold": "gold_coverage", "retrieval": "hit_mrr_ndcg",
    "compare": "graph_criteria", "criteria": "noise_vertices", "rejudge": "cohen_kappa", "judge-matrix": "judge_matrix", "variants": "variant_report", "train": "trained_links", "queries": "query_graph_entities", "rag": "source_unit_support", "lab3-retrieval": "query_vertices", "units": "p1_values",
}


def export(t: Tables, target: str) -> None:
    """One Markdown file a chunk, of the normalised text."""
    files.export_markdown(plans.normalize_pipeline(t), target)


def graphs(t: Tables, target: str) -> None:
    """The graph as GraphML."""
    e = GP.edges(t)
    files.write_graphml(G.complete(GP.vertices(t), e).groupBy("name").agg(F.min("type").alias("type"), F.min("lang").alias("lang")), e, target)


def features(t: Tables, target: str) -> None:
    """Vectors of the vertices under the trained encoders."""
    from kiln.operators import linkmodel as L
    from kiln.plans.vectors import features as given

    e, x = GP.edges(t).filter("src <> dst"), given(t)
    L.encode(x, e, L.train(x, e)).write.mode("overwrite").parquet(target)


#: Stages that write something else than the rows of a query.
WRITERS: dict[str, Callable[[Tables, str], None]] = {"export": export, "graphs": graphs, "features": features}


def ask(spark: SparkSession, folder: str, question: str) -> DataFrame:
    """(position, name, score): vertices for a question given as text: the most similar names, and what lies about them in the graph."""
    from kiln.operators import rag, similarity

    t = Tables(spark, folder)
    words = spark.createDataFrame([(question, w) for w in {question, *question.split()}], "question_id string, name string")
    near = similarity.similar(words.select(F.upper("name").alias("name")), GP.names(t), 0.5).groupBy(F.col("b").alias("name")).agg(F.max("score").alias("score"))
    exact = GP.names(t).join(words.select(F.upper("name").alias("name")), "name", "left_semi").withColumn("score", F.lit(1.0))
    scores = near.unionByName(exact).groupBy("name").agg(F.max("score").alias("score"))
    seeds = scores.orderBy(F.desc("score"), "name").limit(3).select(F.lit(question).alias("question_id"), "name")
    return rag.expand(seeds, scores, GP.edges(t)).join(scores, "name", "left").select("position", "name", "score")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=sorted({*STAGES, *WRITERS, "ask", *registry.queries()}))
    p.add_argument("source", help="folder with the tables as NAME.parquet")
    p.add_argument("target", help="folder for the result")
    p.add_argument("--question", default="", help="the question of stage ask")
    p.add_argument("--cores", type=int, default=8)
    a = p.parse_args()
    spark = local_session(a.cores, a.cores)
    if a.stage in WRITERS:
        WRITERS[a.stage](Tables(spark, a.source), a.target)
    elif a.stage == "ask":
        ask(spark, a.source, a.question).write.mode("overwrite").parquet(a.target)
    else:
        registry.queries()[STAGES.get(a.stage, a.stage)](spark, a.source).write.mode("overwrite").parquet(a.target)
    clear(spark)


if __name__ == "__main__":
    main()
