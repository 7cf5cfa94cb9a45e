"""Nulls in every column, repeated rows and empty tables do not break a core operator."""

from pyspark.sql import functions as F

from kiln.operators import blocks as B
from kiln.operators import chunking as K
from kiln.operators import cleaning as C
from kiln.operators import evaluation as E
from kiln.operators import graph as G
from kiln.operators import normalization as N
from kiln.operators import quality as Q
from kiln.operators import rag as R
from kiln.operators import vectors as V


def test_text_operators(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("a", "para one\npara- \ntwo", "paragraph", 0, 5), ("a", "", None, None, None), (None, "Text [3] 900 deg C", "heading", 2, 9)], "g string, text string, kind string, start_pos int, end_pos int")
    for part in (df, df.limit(0)):
        B.split_blocks(part, "g").count()
        B.parse_markdown(part, "g").count()
        B.furniture(part, "g").count()
        B.broken_pairs(part, "g", ["start_pos"]).count()
        B.sections(part, "g", ["start_pos"]).count()
        B.merge_broken(part.filter("text is not null"), "g", ["start_pos"]).count()
        C.clean(part, "g").count()
        C.audit(part, "g").count()
        C.vocabulary(part, "g").count()
        C.noise_characters(part, "g", ["a"]).count()
        C.numbers(part, "g").count()
        part.select(*C.text_measures(F.col("text"))).collect()
        part.select(N.normalize(F.col("text")), *N.mask(F.col("text"))).collect()
        N.annotate(part, "g", {"para": "x"}).count()
        N.terms(part).count()
        K.token_windows(part, "g", size=5, overlap=1).count()
        K.word_windows(part, "g", size=2).count()
        K.structural_chunks(part.filter("start_pos is not null"), "g").count()
        K.overlapped(part, "g", ["start_pos"]).count()
        Q.ngram_terms(part, "g", least=1).count()


def test_tables_and_graphs(spark):
    v = spark.createDataFrame([(None,), ("A",), ("A",), ("B",)], "name string")
    e = spark.createDataFrame([("A", "B", 1.0), ("A", "B", 1.0), ("B", "B", 2.0)], "src string, dst string, weight double")
    assert G.degrees(v.filter("name is not null"), e).count() == 2
    assert {r.component for r in G.components(v.filter("name is not null"), e).collect()} == {"A"}
    G.communities(v.filter("name is not null"), e).count()
    s = spark.createDataFrame([(None, None, None), ("q", True, 0.5), ("q", None, 0.5)], "g string, label boolean, score double")
    for part in (s, s.limit(0)):
        E.roc_auc(part, ["g"]).count()
        E.average_precision(part, ["g"]).count()
        E.kappa(part.withColumn("b", F.col("label")), ["g"], "label", "b").count()
    x = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (50, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert V.topk(x.filter("vec_id = 50"), x, 2).count() == 2 and V.within(x.limit(0), x, 0.5).count() == 0
    d = spark.createDataFrame([(None, None), ("d", ["a"]), ("e", [])], "k string, words array<string>")
    assert V.tfidf(d, "k").count() == 1
    q = spark.createDataFrame([(None, None, None), ("q", "b", [None, "x"])], "question_id string, book string, evidence array<string>")
    u = spark.createDataFrame([(None, None, None), ("u", "b", "x y")], "unit_id string, book string, text string")
    R.all_evidence(q, u).count()
    R.all_evidence(q, u, False).count()
