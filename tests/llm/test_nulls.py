"""Nulls in every column, keys included, extra columns with clashing names, and empty tables do not break an operator."""

import pytest

from kiln.llm import consensus, leak, lookalike, markup, mixture, pairs, scan, tokens, toxic


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, None, None, None, None, None, 1.0, "x"), (1, "You idiot. Grain size of the strip.", "a", "en", "b", None, 2.0, "y"), (2, "", None, None, None, "t", None, None), (None, "text without an id", "a", None, "b", "t", None, None), (1, "You idiot. Grain size of the strip.", "a", "en", "b", None, 2.0, "y")]
    return table(spark, rows, "doc_id long, text string, source string, lang string, book string, topic string, score double, token string")


def test_documents(spark, docs):
    labels = table(spark, [(None, None, None, None), (1, 1, "abuse", "r"), (1, 1, "abuse", "r"), (2, 0, None, None)], "doc_id long, toxic int, category string, reviewer string")
    assert toxic.scores(docs, labels).count() == 2
    assert toxic.rates(docs, labels).count() == 2
    items = table(spark, [(None, None), (None, "Grain size of the strip"), (7, "a")], "item_id long, item_text string")
    leak.found(docs, items).collect()
    targets = table(spark, [("a", 1.0, 2), (None, None, None), ("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixture.mixture(docs, targets).filter("source <> 'a'").count() == 0
    chunks = table(spark, [(None, None, None, None), ("c1", "b", "en", "Grain size")], "chunk_id string, book string, lang string, text string")
    counted = table(spark, [(None, None, None, None, None), ("c1", "b", 4, 5, "2025")], "chunk_id string, book string, o200k_tokens int, bge_tokens int, counted_at string")
    catalog = table(spark, [(None, None, None, None), ("b", "en", "a", "t")], "book string, lang string, source string, topic string")
    tokens.budget(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), catalog, chunks, counted).collect()
    tokens.chunk_budget(catalog, chunks, counted).collect()


def test_blocks_and_chunks(spark):
    b = table(spark, [(None, None, 1), (None, "<b>x</b> y z", 2), (3, "<h2>Head</h2>", 3), (4, "The strip of the mill is cold.", 4)], "block_id long, text string, clean_text int")
    assert (3, "heading") in {tuple(r) for r in markup.found(b).collect()}
    c = table(spark, [(None, None, None, None, 1), ("c", None, None, "ｗｏｒｄ grаdе", 2), (None, "b", "S", "", 3)], "chunk_id string, book string, section string, text string, word int")
    e = table(spark, [(None, None), (1, "ｗｏｒｄ")], "qe_id long, name string")
    assert {tuple(r) for r in lookalike.found(c, e).collect()} == {("chunk", "c"), ("query_entity", "1")}
    a = table(spark, [(None, None, None, None), (1, "c_c1", "mis-\nread", None)], "audit_id long, chunk_id string, before_text string, after_text string")
    t = table(spark, [(None, None), ("b", "Title")], "book string, title string")
    scan.noise(c, a, t).collect()
    scan.repaired(c, a, t).collect()
    assert scan.noise(c.limit(0), a.limit(0), t.limit(0)).count() == 0


def test_judges_and_questions(spark):
    j = table(spark, [(None, None, None), (1, {"a": None}, None), (2, {"a": True, "b": True}, "x"), (None, {"a": True}, "y"), (3, {}, "z")], "item_id long, judge_flags map<string,boolean>, judged_at string")
    consensus.found(j).collect()
    consensus.agreement(j).collect()
    q = table(spark, [(None, None, None, None, "x"), ("q", None, None, None, "x"), ("r", "Why?", "", "en", "x")], "question_id string, question string, answer string, lang string, defect string")
    s = table(spark, [(None, None)], "question_id string, abstention boolean")
    assert {r.defect for r in pairs.found(q, s).collect()} == {"empty"}
    assert pairs.found(q.limit(0), s).count() == 0
