"""Queries on composed stages, similar names, kept and lost spans, detection and variants, and the trained encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators import blocks as B
from kiln.operators import cleaning as C
from kiln.operators import evaluation as E
from kiln.operators import graph as G
from kiln.operators import linkmodel as L
from kiln.operators import normalization as N
from kiln.operators import pipeline as P
from kiln.operators import similarity as S
from kiln.operators import vectors as V
from kiln.plans import graph as GP
from kiln.plans.base import Tables, query
from kiln.plans.blocks import distinct_blocks
from kiln.plans.cleaning import CHUNKS, chunks
from kiln.plans.evaluation import FLAGS, SCORES, flags, scores
from kiln.plans.vectors import features, hashed
from kiln.session import cut


@query(r"""
WITH b AS (SELECT chunk_id, replace(unnest(regexp_extract_all(text, '\$[^$\n]+\$')), ' ', '') AS formula FROM """ + CHUNKS + r""")
SELECT chunk_id, formula, count(*) AS n_before, count(*) FILTER (NOT regexp_matches(formula, '^\$\^\{?[0-9,]+\}?\$$')) AS n_kept, count(*) FILTER (regexp_matches(formula, '^\$\^\{?[0-9,]+\}?\$$')) AS n_lost FROM b GROUP BY 1, 2
""")
def formulas_kept(t: Tables) -> DataFrame:
    """Formulas of the chunks that are left when citation marks in formula dress are taken out."""
    rule = next(r for r in C.CLEANING if r.name == "superscripts")
    return C.kept_and_lost(C.formulas(chunks(t), "chunk_id"), C.formulas(C.clean(chunks(t), "chunk_id", rules=[rule]), "chunk_id", "clean"))


@query(r"""
WITH b AS (SELECT chunk_id, lower(trim(unnest(regexp_extract_all(text, '<td>([^<]*)</td>', 1)))) AS cell FROM """ + CHUNKS + r"""),
k AS (SELECT chunk_id, cell, count(*) AS n_before, count(*) FILTER (regexp_matches(cell, '[0-9]')) AS n_kept FROM b WHERE cell <> '' GROUP BY 1, 2)
SELECT chunk_id, cell, n_before, n_kept, n_before - n_kept AS n_lost FROM k
""")
def cells_kept(t: Tables) -> DataFrame:
    """Cells of the chunks' tables that are left when those without a digit are taken out."""
    before = C.cells(chunks(t), "chunk_id")
    return C.kept_and_lost(before, before.filter(F.col("cell").rlike("[0-9]")))


@query(rf"""
WITH m AS (SELECT book, list_transform(regexp_extract_all(text, '(-?[0-9]+(?:[.,][0-9]+)?) ?°C', 1), lambda x: replace(x, ',', '.')::DOUBLE) AS d, list_transform(regexp_extract_all(text, '(?:^|[^0-9.,])([12][0-9]{{3}})(?:[^0-9.,]|$)', 1), lambda x: x::INT) AS y FROM {CHUNKS})
SELECT book, sum(len(d))::BIGINT AS n_temperatures, sum(len(list_filter(d, lambda x: x >= -273 AND x <= 1600)))::BIGINT AS n_sound_temperatures, sum(len(y))::BIGINT AS n_years, sum(len(list_filter(y, lambda x: x >= 1800 AND x <= 2100)))::BIGINT AS n_sound_years FROM m GROUP BY book
""")
def value_checks(t: Tables) -> DataFrame:
    cols = ["n_temperatures", "n_sound_temperatures", "n_years", "n_sound_years"]
    return chunks(t).select("book", *N.value_checks(F.col("text"))).groupBy("book").agg(*[F.sum(c).alias(c) for c in cols])


def _latin_sql(c: str) -> str:
    out = f"lower({c})"
    for a, b in S.LATIN.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


KEY = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END), ' ')"
PAIRS = f"""
t AS (SELECT DISTINCT title AS name, ' ' || {_latin_sql('title')} || ' ' AS s FROM entity_titles WHERE title IS NOT NULL),
g AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) AS g FROM t),
p AS (SELECT x.name AS a, y.name AS b, round(len(list_intersect(x.g, y.g)) / sqrt(len(x.g) * len(y.g)::DOUBLE), 6) AS score, regexp_matches(x.name, '\\p{{Cyrillic}}') <> regexp_matches(y.name, '\\p{{Cyrillic}}') AS "cross" FROM g x JOIN g y ON x.name < y.name)
"""


def titles(t: Tables) -> DataFrame:
    return t.entity_titles.select(F.col("title").alias("name"))


@query(f"""WITH {PAIRS} SELECT a, b, score, "cross" FROM p WHERE score >= CASE WHEN "cross" THEN 0.4 ELSE 0.6 END AND {KEY.format('a')} <> {KEY.format('b')}""")
def similar_names(t: Tables) -> DataFrame:
    return S.coreferent(titles(t), 0.6, 0.4)


@query(f"WITH {PAIRS}, n AS (SELECT unnest([0.95, 0.92, 0.85, 0.8, 0.7, 0.6, 0.5]::DOUBLE[]) AS threshold) SELECT threshold, (SELECT count(*) FROM p WHERE score >= threshold) AS n_pairs, (SELECT count(DISTINCT x) FROM (SELECT unnest([a, b]) AS x FROM p WHERE score >= threshold)) AS n_names FROM n")
def coreference_sweep(t: Tables) -> DataFrame:
    return S.sweep(S.similar(titles(t), titles(t), 0.5).filter("a < b"), [0.95, 0.92, 0.85, 0.8, 0.7, 0.6, 0.5])


@query(f"""
WITH t AS (SELECT DISTINCT upper(trim(name)) AS term FROM query_entities WHERE name IS NOT NULL), e AS (SELECT DISTINCT title AS name FROM entity_titles WHERE title IS NOT NULL),
x AS (SELECT term, {KEY.format('term')} AS k, ' ' || {_latin_sql('term')} || ' ' AS s FROM t), y AS (SELECT name, {KEY.format('name')} AS k, ' ' || {_latin_sql('name')} || ' ' AS s FROM e),
gx AS (SELECT term, k, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) AS g FROM x), gy AS (SELECT name, k, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) AS g FROM y)
SELECT term, bool_or(contains(' ' || y.k || ' ', ' ' || x.k || ' ')) AS lexical, bool_or(contains(' ' || y.k || ' ', ' ' || x.k || ' ') OR (term <> name AND round(len(list_intersect(x.g, y.g)) / sqrt(len(x.g) * len(y.g)::DOUBLE), 6) >= 0.8)) AS similar FROM gx x, gy y GROUP BY term
""")
def domain_coverage(t: Tables) -> DataFrame:
    """Each queried name: whether it stands within a title, and whether it does or a title is similar to it."""
    return S.coverage(t.query_entities.filter("name is not null").select(F.upper(F.trim("name")).alias("term")), titles(t))


@query(f"""
WITH x AS (SELECT f.arm, f.flag AS p, j.has_contradiction AS w, length(j.evidence) AS k FROM {FLAGS} f JOIN (SELECT item_id, arm, bool_or(has_contradiction) AS has_contradiction, max(evidence) AS evidence FROM judge_adjudication WHERE has_contradiction IS NOT NULL GROUP BY 1, 2) j USING (item_id, arm) WHERE f.flag IS NOT NULL),
s AS (SELECT arm, grouping(arm)::INT AS total, count(*) AS n, count(*) FILTER (p AND w) AS tp, count(*) FILTER (p AND NOT w) AS fp, count(*) FILTER (NOT p AND w) AS fn, sum(k)::BIGINT AS k FROM x GROUP BY ROLLUP (arm)),
f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 1.0) AS f1 FROM s)
SELECT arm, total, n, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(f1, 6) AS f1, CASE WHEN total = 1 THEN round((SELECT sum(f1 * k) / sum(k) FROM f WHERE total = 0), 6) END AS weighted_f1 FROM f
""")
def judge_detection(t: Tables) -> DataFrame:
    j = t.judge_adjudication.filter("has_contradiction is not null").groupBy("item_id", "arm").agg(F.bool_or("has_contradiction").alias("has_contradiction"), F.max("evidence").alias("evidence"))
    rows = flags(t).filter("flag is not null").join(j, ["item_id", "arm"]).withColumn("k", F.length("evidence"))
    out = E.detection(rows, ["arm"], "flag", "has_contradiction", "k")
    return out.select("arm", "total", "n", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "weighted_f1")])


METRICS = {
    "recall": ("share", "avg(context_recall)"), "faithfulness": ("share", "avg(faithfulness)"), "abstention": ("share", "avg(CAST(abstention AS INT))"), "full_recall": ("share", "avg(CAST(context_recall >= 1 AS INT))"), "no_recall": ("share", "avg(CAST(context_recall <= 0 AS INT))"),
    "full_faith": ("share", "avg(CAST(faithfulness >= 1 AS INT))"), "n_scores": ("count", "CAST(count(*) AS DOUBLE)"), "n_questions": ("count", "CAST(count(DISTINCT question_id) AS DOUBLE)"),
}
LONG = " UNION ALL ".join(f"SELECT graph AS variant, judge AS repeat, '{m}' AS metric, '{k}' AS kind, {e}::DOUBLE AS value FROM {SCORES} WHERE judge IS NOT NULL GROUP BY 1, 2" for m, (k, e) in METRICS.items())


@query(f"""
WITH r AS ({LONG}), p AS (SELECT metric, variant, any_value(kind) AS kind, avg(value) AS value, max(value) - min(value) AS spread FROM r WHERE value IS NOT NULL GROUP BY 1, 2), z AS (SELECT metric, max(spread) AS noise FROM p GROUP BY 1)
SELECT p.metric, p.variant, p.kind, round(b.value, 6) AS base_value, round(p.value, 6) AS value, round(p.value - b.value, 6) AS delta, round(noise, 6) AS noise, abs(p.value - b.value) > 2 * noise AND abs(p.value - b.value) >= CASE WHEN p.kind = 'share' THEN 0.03 ELSE abs(b.value) * 0.1 END AS clear
FROM p JOIN p b ON b.metric = p.metric AND b.variant = 'dirty' JOIN z ON z.metric = p.metric WHERE p.variant <> 'dirty'
""")
def variant_report(t: Tables) -> DataFrame:
    s = scores(t).filter("judge is not null").groupBy(F.col("graph").alias("variant"), F.col("judge").alias("repeat")).agg(*[F.expr(e).cast("double").alias(m) for m, (_, e) in METRICS.items()])
    long = s.select("variant", "repeat", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), F.col(m).alias("value")) for m, (k, _) in METRICS.items()])).alias("x")).select("variant", "repeat", "x.*")
    out = E.variant_report(long, "dirty")
    return out.select("metric", "variant", "kind", *[F.round(c, 6).alias(c) for c in ("base_value", "value", "delta", "noise")], "clear")


def _cleaned(t: Tables) -> tuple[DataFrame, DataFrame]:
    return P.clean_book(distinct_blocks(t), "chunk_id", ["idx", "block_id"], B.furniture(t.chunks, "chunk_id"))


@query()
def clean_pipeline(t: Tables) -> DataFrame:
    return _cleaned(t)[0]


@query()
def clean_pipeline_audit(t: Tables) -> DataFrame:
    return _cleaned(t)[1]


@query()
def normalize_pipeline(t: Tables) -> DataFrame:
    c = cut(chunks(t).select("chunk_id", "text"))
    lexicon = N.plurals(c.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")))
    return P.normalize_text(c, "chunk_id", lexicon, {"аустенит": "austenite", "феррит": "ferrite"}, {"Fig.": "Figure", "Рис.": "Рисунок", "Abb.": "Abbildung"})


@query()
def graph_criteria(t: Tables) -> DataFrame:
    """All criteria of the graph; terms are the queried names."""
    v = G.complete(GP.vertices(t), GP.edges(t))
    q = t.query_entities.filter("name is not null").select(F.upper(F.trim("name")).alias("name"), F.col("question_id").alias("unit_id")).distinct()
    return P.evaluate_graph(v, GP.edges(t), q.select(F.col("name").alias("term")), q)


@query()
def trained_links(t: Tables) -> DataFrame:
    """Held-out edges against drawn pairs under the trained encoders: area under the curve and average precision."""
    e = GP.edges(t).filter("src <> dst")
    split, x = V.link_split(e), cut(features(t))
    vectors = cut(L.encode(x, split.filter("part = 'train'"), L.train(x, e)))
    test = split.filter("part = 'test'").select("src", "dst")
    rows = test.withColumn("label", F.lit(True)).unionByName(V.negatives(e, GP.names(t)).withColumn("label", F.lit(False))).withColumn("arm", F.lit("names"))
    s = V.link_scores(rows, vectors)
    return E.roc_auc(s, ["arm"]).join(E.average_precision(s, ["arm"]), "arm")


@query()
def query_vertices(t: Tables) -> DataFrame:
    """The nearest vertex of each name of a query graph, names encoded from their own features and their neighbours in their question; vertices and names by the same trained encoders. Names are asked once each."""
    e, x = GP.edges(t).filter("src <> dst"), cut(features(t))
    encoders = L.train(x, e)
    vertices = L.encode(x, e, encoders)
    asked = t.query_entities.filter("name is not null").select("question_id", F.upper(F.trim("name")).alias("name")).distinct()
    own = hashed(asked.select("name").distinct())
    pairs = asked.withColumn("next", F.lead("name").over(Window.partitionBy("question_id").orderBy("name"))).filter("next is not null").select(F.col("name").alias("src"), F.col("next").alias("dst"))
    names = L.encode(own, pairs, encoders)
    best = V.topk(names.select(F.col("name").alias("key"), "x"), vertices.select(F.col("name").alias("key"), "x"), 1, "key", "x", others=False)
    return best.select(F.col("query_id").alias("name"), F.col("key").alias("vertex"), "score")
