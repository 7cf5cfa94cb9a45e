"""Queries on retrieval, answers, judges, graph quality and question answering over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators import evaluation as E
from kiln.operators import graph as G
from kiln.operators import quality as Q
from kiln.operators import rag as R
from kiln.plans import graph as GP
from kiln.plans.base import Tables, query
from kiln.session import cut

SCORES = "(SELECT DISTINCT graph, retriever, question_id, judge, context_recall, faithfulness, abstention FROM semantic_scores)"


def scores(t: Tables) -> DataFrame:
    return t.semantic_scores.select("graph", "retriever", "question_id", "judge", "context_recall", "faithfulness", "abstention").distinct()


@query(f"""
SELECT graph, retriever, count(*) AS n, round(avg(context_recall), 6) AS recall, count(context_recall) AS n_recall, round(avg(faithfulness) FILTER (NOT coalesce(abstention, false)), 6) AS faithfulness,
  count(*) FILTER (abstention) AS n_abstained, round(count(*) FILTER (context_recall >= 0.5) / greatest(count(*), 1)::DOUBLE, 6) AS good_share FROM {SCORES} GROUP BY 1, 2
""")
def run_metrics(t: Tables) -> DataFrame:
    s = scores(t)
    good = F.count_if(F.col("context_recall") >= 0.5) / F.greatest(F.count("*"), F.lit(1))
    return s.groupBy("graph", "retriever").agg(F.count("*").alias("n"), F.round(F.avg("context_recall"), 6).alias("recall"), F.count("context_recall").alias("n_recall"), F.round(F.avg(F.when(~F.coalesce("abstention", F.lit(False)), F.col("faithfulness"))), 6).alias("faithfulness"), F.count_if("abstention").alias("n_abstained"), F.round(good, 6).alias("good_share"))


@query(f"""
WITH m AS (SELECT graph, retriever, judge, avg(context_recall) AS r FROM {SCORES} WHERE context_recall IS NOT NULL GROUP BY 1, 2, 3)
SELECT graph, retriever, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, count(*) AS n_judges, round(max(r), 6) AS best FROM m GROUP BY 1, 2
""")
def seed_stats(t: Tables) -> DataFrame:
    m = scores(t).filter("context_recall is not null").groupBy("graph", "retriever", "judge").agg(F.avg("context_recall").alias("r"))
    return m.groupBy("graph", "retriever").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("std"), F.count("*").alias("n_judges"), F.round(F.max("r"), 6).alias("best"))


RANKED = f"(SELECT graph, question_id, retriever, row_number() OVER (PARTITION BY graph, question_id ORDER BY r DESC, retriever) AS rank, r >= 0.75 AS relevant FROM (SELECT graph, question_id, retriever, max(context_recall) AS r FROM {SCORES} WHERE context_recall IS NOT NULL GROUP BY 1, 2, 3))"


@query(f"""
WITH g AS (SELECT graph || ':' || question_id AS q, min(rank) FILTER (relevant) AS first_rank, sum(CASE WHEN relevant AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (relevant) AS n FROM {RANKED} GROUP BY 1),
i AS (SELECT *, list_sum([1 / log2(k + 1) FOR k IN range(1, greatest(1, least(n, 10)) + 1)]) AS ideal FROM g)
SELECT q, first_rank::INT AS first_rank, coalesce(first_rank <= 1, false)::INT AS hit_1, coalesce(first_rank <= 3, false)::INT AS hit_3, coalesce(first_rank <= 5, false)::INT AS hit_5, round(coalesce(1.0 / first_rank, 0), 6) AS rr, round(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM i
""")
def hit_mrr_ndcg(t: Tables) -> DataFrame:
    best = scores(t).filter("context_recall is not null").groupBy("graph", "question_id", "retriever").agg(F.max("context_recall").alias("r"))
    w = Window.partitionBy("graph", "question_id").orderBy(F.desc("r"), "retriever")
    hits = best.select(F.concat_ws(":", "graph", "question_id").alias("q"), F.row_number().over(w).alias("rank"), (F.col("r") >= 0.75).alias("relevant"))
    return E.ranking(hits, "q").withColumn("rr", F.round("rr", 6)).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""
WITH r AS (SELECT graph, question_id, min(rank) FILTER (relevant) AS f FROM {RANKED} GROUP BY 1, 2), l AS (SELECT question_id, min(coalesce(lang, 'none')) AS lang FROM questions GROUP BY 1),
x AS (SELECT graph, f, unnest(['all', lang]) AS "group" FROM r JOIN l USING (question_id))
SELECT graph, "group", count(*) AS n, round(avg(CASE WHEN f IS NULL THEN 0 ELSE 1.0 / f END), 6) AS mrr, round(avg(coalesce(f <= 1, false)::INT), 6) AS hit_1 FROM x GROUP BY 1, 2
""")
def retrieval_groups(t: Tables) -> DataFrame:
    best = scores(t).filter("context_recall is not null").groupBy("graph", "question_id", "retriever").agg(F.max("context_recall").alias("r"))
    w = Window.partitionBy("graph", "question_id").orderBy(F.desc("r"), "retriever")
    f = best.withColumn("rank", F.row_number().over(w)).groupBy("graph", "question_id").agg(F.min(F.when(F.col("r") >= 0.75, F.col("rank"))).alias("f"))
    lang = t.questions.groupBy("question_id").agg(F.min(F.coalesce("lang", F.lit("none"))).alias("lang"))
    x = f.join(lang, "question_id").select("graph", "f", F.explode(F.array(F.lit("all"), "lang")).alias("group"))
    return x.groupBy("graph", "group").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(F.col("f") <= 1, F.lit(False)).cast("int")), 6).alias("hit_1"))


@query("""
SELECT q.question_id, b.chunk_id FROM (SELECT DISTINCT question_id, book, evidence FROM questions WHERE len(evidence) > 0) q JOIN (SELECT DISTINCT chunk_id, book, lower(text) AS low FROM chunks) b ON b.book = q.book
WHERE len(list_filter(q.evidence, lambda e: NOT contains(b.low, lower(e)))) = 0 GROUP BY 1, 2
""")
def evidence_in_book(t: Tables) -> DataFrame:
    units = t.chunks.select(F.col("chunk_id").alias("unit_id"), "book", "text").distinct()
    return R.all_evidence(t.questions.select("question_id", "book", "evidence").distinct(), units).select("question_id", F.col("unit_id").alias("chunk_id"))


@query("""
WITH q AS (SELECT DISTINCT question_id, evidence FROM questions WHERE len(evidence) > 0 AND question_id IS NOT NULL AND len(list_filter(evidence, lambda e: e IS NULL)) = 0), c AS (SELECT DISTINCT chunk_id, lower(text) AS low FROM chunks)
SELECT DISTINCT question_id, chunk_id FROM q JOIN c ON len(list_filter(evidence, lambda e: NOT contains(low, lower(e)))) = 0 AND low IS NOT NULL
""")
def evidence_anywhere(t: Tables) -> DataFrame:
    units = t.chunks.select(F.col("chunk_id").alias("unit_id"), "book", "text").distinct()
    return R.all_evidence(t.questions.select("question_id", "book", "evidence").distinct(), units, match_book=False).select("question_id", F.col("unit_id").alias("chunk_id"))


@query(r"""
WITH q AS (SELECT question_id, max(answer) AS answer, max(evidence) AS evidence FROM questions GROUP BY 1),
s AS (SELECT question_id, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '\p{L}+')) AS got, list_distinct(regexp_extract_all(lower(array_to_string(evidence, ' ')), '\p{L}+')) AS wanted FROM q)
SELECT question_id, round(len(list_intersect(got, wanted)) / nullif(len(got), 0)::DOUBLE, 6) AS precision, round(len(list_intersect(got, wanted)) / nullif(len(wanted), 0)::DOUBLE, 6) AS recall FROM s
""")
def context_precision_recall(t: Tables) -> DataFrame:
    q = t.questions.groupBy("question_id").agg(F.max("answer").alias("answer"), F.max("evidence").alias("evidence"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)))
    s = q.select("question_id", words(F.coalesce("answer", F.lit(""))).alias("got"), words(F.array_join("evidence", " ")).alias("wanted"))
    p, r = E.precision_recall(s, "got", "wanted")
    return s.select("question_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@query("""
SELECT question_id, bool_or(coalesce(key_pattern <> '' AND contains(answer, key_pattern), false)) AS key_in_answer FROM questions GROUP BY 1
""")
def key_fact_presence(t: Tables) -> DataFrame:
    return t.questions.groupBy("question_id").agg(F.max(F.coalesce((F.col("key_pattern") != "") & F.contains("answer", "key_pattern"), F.lit(False))).alias("key_in_answer"))


@query("""
SELECT question_id FROM (SELECT DISTINCT question_id FROM questions) WHERE question_id NOT IN (SELECT question_id FROM semantic_scores WHERE question_id IS NOT NULL)
""")
def pending_jobs(t: Tables) -> DataFrame:
    return t.questions.select("question_id").distinct().join(t.semantic_scores, "question_id", "left_anti")


@query(f"SELECT question_id FROM {SCORES} WHERE question_id NOT IN (SELECT question_id FROM {SCORES} WHERE context_recall IS NULL) GROUP BY 1 HAVING count(DISTINCT graph) = 2")
def usable_questions(t: Tables) -> DataFrame:
    s = scores(t)
    return s.join(s.filter("context_recall is null").select("question_id").distinct(), "question_id", "left_anti").groupBy("question_id").agg(F.countDistinct("graph").alias("k")).filter("k = 2").select("question_id")


FLAGS = "(SELECT DISTINCT item_id, arm, unnest(map_keys(judge_flags)) AS judge, unnest(map_values(judge_flags)) AS flag FROM judge_adjudication)"


def flags(t: Tables) -> DataFrame:
    return t.judge_adjudication.filter("judge_flags is not null").select("item_id", "arm", F.explode("judge_flags").alias("judge", "flag")).distinct()


@query(f"SELECT judge, count(DISTINCT arm) AS n_arms, count(*) AS n, round(avg(flag::INT), 6) AS flagged FROM {FLAGS} WHERE flag IS NOT NULL GROUP BY 1 HAVING count(DISTINCT arm) = 2")
def judges_covering(t: Tables) -> DataFrame:
    return flags(t).filter("flag is not null").groupBy("judge").agg(F.countDistinct("arm").alias("n_arms"), F.count("*").alias("n"), F.round(F.avg(F.col("flag").cast("int")), 6).alias("flagged")).filter("n_arms = 2")


PAIR = f"(SELECT a.arm, a.judge AS left_judge, b.judge AS right_judge, a.flag AS x, b.flag AS y FROM {FLAGS} a JOIN {FLAGS} b ON a.item_id = b.item_id AND a.judge < b.judge WHERE a.flag IS NOT NULL AND b.flag IS NOT NULL)"


def judge_pair_rows(t: Tables) -> DataFrame:
    """Votes of two judges on one item; an item has as many votes as there are judges, so the pairs of an item are few."""
    f = t.judge_adjudication.filter("judge_flags is not null").select("item_id", "arm", F.array_sort(F.map_entries(F.map_filter("judge_flags", lambda k, v: v.isNotNull()))).alias("v")).distinct()
    first = f.select("item_id", "arm", F.posexplode("v").alias("i", "a"), "v")
    both = first.select("item_id", "arm", "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    return both.select("item_id", "arm", F.col("a.key").alias("left_judge"), F.col("b.key").alias("right_judge"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))


@query(f"""
WITH s AS (SELECT arm, left_judge, right_judge, count(*)::DOUBLE AS n, count(*) FILTER (x = y) AS same, count(*) FILTER (x) AS p, count(*) FILTER (y) AS q FROM {PAIR} GROUP BY 1, 2, 3), e AS (SELECT *, (p * q + (n - p) * (n - q)) / (n * n) AS ex FROM s)
SELECT arm, left_judge, right_judge, n::BIGINT AS n, round(same / n, 6) AS agree, round(CASE WHEN ex = 1 THEN 1 ELSE (same / n - ex) / (1 - ex) END, 6) AS kappa FROM e
""")
def cohen_kappa(t: Tables) -> DataFrame:
    return E.kappa(judge_pair_rows(t), ["arm", "left_judge", "right_judge"], "x", "y").withColumn("agree", F.round("agree", 6)).withColumn("kappa", F.round("kappa", 6))


@query(f"SELECT left_judge, right_judge, count(*) FILTER (x AND y) AS yes_yes, count(*) FILTER (x AND NOT y) AS yes_no, count(*) FILTER (NOT x AND y) AS no_yes, count(*) FILTER (NOT x AND NOT y) AS no_no FROM {PAIR} GROUP BY 1, 2")
def judge_matrix(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return judge_pair_rows(t).groupBy("left_judge", "right_judge").agg(F.count_if(x & y).alias("yes_yes"), F.count_if(x & ~y).alias("yes_no"), F.count_if(~x & y).alias("no_yes"), F.count_if(~x & ~y).alias("no_no"))


@query(f"""
WITH j AS (SELECT DISTINCT item_id, arm, has_contradiction FROM judge_adjudication WHERE has_contradiction IS NOT NULL)
SELECT f.judge, count(*) AS n, count(*) FILTER (f.flag = j.has_contradiction) AS n_same, round(count(*) FILTER (f.flag = j.has_contradiction) / count(*)::DOUBLE, 6) AS share FROM {FLAGS} f JOIN j USING (item_id, arm) WHERE f.flag IS NOT NULL GROUP BY 1
""")
def judge_accuracy(t: Tables) -> DataFrame:
    j = t.judge_adjudication.filter("has_contradiction is not null").select("item_id", "arm", "has_contradiction").distinct()
    same = F.count_if(F.col("flag") == F.col("has_contradiction"))
    return flags(t).filter("flag is not null").join(j, ["item_id", "arm"]).groupBy("judge").agg(F.count("*").alias("n"), same.alias("n_same"), F.round(same / F.count("*"), 6).alias("share"))


@query("""
SELECT arm, count(*) AS n, round(avg(has_contradiction::INT), 6) AS contradiction_share, count(*) FILTER (confidence = 'high') AS n_sure FROM (SELECT DISTINCT item_id, arm, has_contradiction, confidence FROM judge_adjudication) GROUP BY arm
""")
def consistency_summary(t: Tables) -> DataFrame:
    d = t.judge_adjudication.select("item_id", "arm", "has_contradiction", "confidence").distinct()
    return d.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("has_contradiction").cast("int")), 6).alias("contradiction_share"), F.count_if(F.col("confidence") == "high").alias("n_sure"))


@query(f"""
WITH m AS (SELECT retriever, graph, avg(context_recall) AS r, avg(faithfulness) AS f FROM {SCORES} GROUP BY 1, 2), p AS (SELECT c.retriever, unnest(['recall', 'faithfulness']) AS metric, unnest([c.r, c.f]) AS value, unnest([d.r, d.f]) AS base FROM m c JOIN m d ON c.retriever = d.retriever AND c.graph = 'clean' AND d.graph = 'dirty')
SELECT retriever, metric, round(value - base, 6) AS delta, abs(value - base) > 2 * 0.01 AND abs(value - base) >= 0.03 AS clear FROM p
""")
def variant_clear(t: Tables) -> DataFrame:
    m = scores(t).groupBy("retriever", "graph").agg(F.avg("context_recall").alias("r"), F.avg("faithfulness").alias("f"))
    c, d = m.filter("graph = 'clean'").drop("graph"), m.filter("graph = 'dirty'").select("retriever", F.col("r").alias("r0"), F.col("f").alias("f0"))
    p = c.join(d, "retriever").selectExpr("retriever", "stack(2, 'recall', r, r0, 'faithfulness', f, f0) as (metric, value, base)")
    return p.select("retriever", "metric", F.round(F.col("value") - F.col("base"), 6).alias("delta"), E.clear_change(F.col("value"), F.col("base"), F.lit(0.01), F.lit("share")).alias("clear"))


AUC = f"(SELECT DISTINCT graph, judge, question_id, retriever, abstention AS label, context_recall AS score FROM {SCORES} WHERE abstention IS NOT NULL AND context_recall IS NOT NULL)"


@query(f"""
WITH c AS (SELECT graph, count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg FROM {AUC} GROUP BY 1), s AS (SELECT graph, score, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q FROM {AUC} GROUP BY 1, 2),
u AS (SELECT a.graph, sum(a.p * b.q * CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u FROM s a JOIN s b ON a.graph = b.graph GROUP BY 1)
SELECT graph, n_pos, n_neg, round(u / nullif(n_pos * n_neg, 0)::DOUBLE, 6) AS auc FROM c JOIN u USING (graph)
""")
def roc_auc(t: Tables) -> DataFrame:
    rows = scores(t).select("graph", "judge", "question_id", "retriever", F.col("abstention").alias("label"), F.col("context_recall").alias("score")).filter("label is not null and score is not null").distinct()
    return E.roc_auc(rows, ["graph"]).withColumn("auc", F.round("auc", 6))


@query(f"""
WITH s AS (SELECT graph, score, count(*) FILTER (label) AS p, count(*) AS n FROM {AUC} GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY graph ORDER BY score DESC))
SELECT graph, round(sum(p * cp / cn::DOUBLE) / nullif(sum(p), 0), 6) AS ap FROM c GROUP BY 1
""")
def avg_precision(t: Tables) -> DataFrame:
    rows = scores(t).select("graph", "judge", "question_id", "retriever", F.col("abstention").alias("label"), F.col("context_recall").alias("score")).filter("label is not null and score is not null").distinct()
    return E.average_precision(rows, ["graph"]).withColumn("ap", F.round("ap", 6))


@query(r"""
SELECT audit_id, round(levenshtein(before_text, after_text) / nullif(length(after_text), 0)::DOUBLE, 6) AS cer FROM (SELECT DISTINCT audit_id, before_text, after_text FROM audit_log) WHERE regexp_matches(before_text, '^[\x20-\x7E]+$') AND regexp_matches(after_text, '^[\x20-\x7E]+$')
""")
def cer_ascii(t: Tables) -> DataFrame:
    a = t.audit_log.select("audit_id", "before_text", "after_text").distinct().filter(F.col("before_text").rlike(r"^[\x20-\x7E]+$") & F.col("after_text").rlike(r"^[\x20-\x7E]+$"))
    return a.select("audit_id", F.round(E.cer(F.col("after_text"), F.col("before_text")), 6).alias("cer"))


@query()
def char_error_rate(t: Tables) -> DataFrame:
    a = t.audit_log.select("audit_id", "before_text", "after_text").distinct().filter("after_text is not null")
    return a.select("audit_id", E.cer(F.col("after_text"), F.coalesce("before_text", F.lit(""))).alias("cer"))


@query()
def word_error_rate(t: Tables) -> DataFrame:
    return E.wer(t.audit_log.select("audit_id", "before_text", "after_text").distinct().filter("after_text is not null"), "audit_id", "after_text", "before_text")


@query()
def gold_coverage(t: Tables) -> DataFrame:
    return E.block_coverage(t.audit_log.select("audit_id", "before_text", "after_text").distinct().filter("after_text is not null"), "audit_id", "after_text", "before_text").withColumn("kept", F.col("coverage") >= 0.6)


NOISE = r"""
SELECT name, array_to_string(list_filter([CASE WHEN regexp_matches(name, '^[\p{P}\p{S}\s]+$') THEN 'punctuation' END, CASE WHEN regexp_matches(name, '\\[a-zA-Z]+') THEN 'latex' END, CASE WHEN regexp_matches(name, '^[0-9.,]+( ?(?:°C|K|MPa|mm|%))?$') THEN 'number' END,
  CASE WHEN upper(name) IN ('IT', 'THIS', 'THEY', 'ОН', 'ОНА', 'ОНО', 'ЭТО', 'ES', 'SIE', 'ER') THEN 'pronoun' END, CASE WHEN regexp_matches(name, '^\p{L}{1,2}$|-$') THEN 'broken' END, CASE WHEN regexp_matches(name, '^\p{Lu}{2}-[0-9]+$') THEN 'code' END], lambda x: x IS NOT NULL), ',') AS labels
FROM (SELECT DISTINCT name FROM query_entities WHERE name IS NOT NULL)
"""


@query(NOISE)
def noise_vertices(t: Tables) -> DataFrame:
    return t.query_entities.filter("name is not null").select("name").distinct().select("name", F.array_join(Q.noise_labels(F.col("name")), ",").alias("labels"))


@query(r"SELECT DISTINCT name FROM query_entities WHERE regexp_matches(name, '[\\=^_{}]|^[\p{Lu}\p{Ll}]_?[0-9]*$|^\p{Lu}\p{Ll}?[0-9]+(?:\p{Lu}\p{Ll}?[0-9]*)*$')")
def formula_vertices(t: Tables) -> DataFrame:
    return t.query_entities.select("name").distinct().filter(Q.is_formula(F.col("name")))


@query(r"""
WITH n AS (SELECT DISTINCT name FROM query_entities WHERE name IS NOT NULL), k AS (SELECT name, array_to_string(list_transform(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END), ' ') AS lemma_key FROM n)
SELECT lemma_key, count(*) AS n, array_to_string(list_sort(list(name)), '|') AS names FROM k WHERE lemma_key <> '' GROUP BY 1 HAVING count(*) > 1
""")
def coreferent_names(t: Tables) -> DataFrame:
    return Q.duplicate_names(t.query_entities.filter("name is not null").select("name"))


@query(r"""
WITH k AS (SELECT title AS term, lang, array_to_string(list_transform(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END), ' ') AS k FROM entity_titles),
n AS (SELECT DISTINCT ' ' || array_to_string(list_transform(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END), ' ') || ' ' AS k FROM query_entities)
SELECT term, EXISTS (SELECT 1 FROM n WHERE contains(n.k, ' ' || k.k || ' ')) AS covered FROM k GROUP BY ALL
""")
def completeness(t: Tables) -> DataFrame:
    return Q.contained_terms(t.entity_titles.select(F.col("title").alias("term")), t.query_entities.filter("name is not null").select("name"))


ATOMS = r"regexp_extract_all(lower({0}), '\p{{L}}{{5,}}')"


@query(f"""
WITH i AS (SELECT qe_id AS item_id, list_distinct({ATOMS.format('name')}) AS a FROM (SELECT DISTINCT qe_id, name FROM query_entities WHERE qe_id % 50 = 0)), w AS (SELECT chunk_id, list_distinct({ATOMS.format('text')}) AS b FROM (SELECT DISTINCT chunk_id, text FROM chunks))
SELECT item_id, len(a)::INT AS n_atoms, round(max(len(list_intersect(a, b))) / len(a)::DOUBLE, 6) AS best FROM i, w WHERE len(a) >= 2 GROUP BY item_id, a
""")
def integrity(t: Tables) -> DataFrame:
    atoms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{5,}"), F.lit(0)).alias("atoms")
    items = t.query_entities.filter("qe_id % 50 = 0").select(F.col("qe_id").alias("item_id"), "name").distinct().select("item_id", atoms("name"))
    windows = t.chunks.select("chunk_id", "text").distinct().select(F.hash("chunk_id", "text").alias("window_id"), atoms("text"))
    return Q.integrity(items, windows).withColumn("best", F.round("best", 6))


@query()
def ngram_terms(t: Tables) -> DataFrame:
    return Q.ngram_terms(t.chunks.select("chunk_id", "text").distinct(), "chunk_id", stop=("the", "of", "is", "by", "in", "a", "and", "to", "for", "при", "в", "на", "die", "der", "das"))


@query(r"""
WITH l AS (SELECT question_id, name, lower(name) AS low FROM (SELECT DISTINCT question_id, name FROM query_entities WHERE name IS NOT NULL)), m AS (SELECT qe_id, description, name FROM (SELECT DISTINCT qe_id, description, name FROM query_entities WHERE description IS NOT NULL AND name IS NOT NULL))
SELECT upper(name) AS name, max_by(description, (len(string_split(lower(description), lower(name))) - 1, description)) AS fragment FROM m GROUP BY 1
""")
def best_fragment(t: Tables) -> DataFrame:
    m = t.query_entities.select("qe_id", "description", "name").distinct().filter("description is not null and name is not null")
    n = (F.length("description") - F.length(F.replace(F.lower("description"), F.lower("name"), F.lit("")))) / F.length("name")
    return m.groupBy(F.upper("name").alias("name")).agg(F.max_by("description", F.struct(n.cast("long").alias("k"), "description")).alias("fragment"))


@query("""
WITH e AS (SELECT DISTINCT question_id, upper(trim(name)) AS name FROM query_entities WHERE name IS NOT NULL)
SELECT question_id, name FROM e UNION SELECT question_id, question FROM questions WHERE question_id NOT IN (SELECT question_id FROM e)
""")
def query_graph_entities(t: Tables) -> DataFrame:
    return R.with_fallback(t.questions.select("question_id", "question"), t.query_entities.select("question_id", F.upper(F.trim("name")).alias("name")))


def query_relations(t: Tables) -> DataFrame:
    one = t.query_entities.groupBy("qe_id", "question_id").agg(F.min("name").alias("name"))
    return one.select("question_id", F.upper(F.trim("name")).alias("source"), F.upper(F.trim(F.lead("name").over(Window.partitionBy("question_id").orderBy("qe_id")))).alias("target")).filter("target is not null and source <> target").distinct()


@query()
def relation_bonus(t: Tables) -> DataFrame:
    e = t.query_entities.filter("name is not null").select("question_id", F.upper(F.trim("name")).alias("name")).distinct()
    rel = R.valid_relations(e, query_relations(t))
    return R.relation_bonus(e.select("question_id", F.col("name").alias("query_name"), "name"), rel, GP.edges(t))


def context(t: Tables) -> DataFrame:
    e = t.query_entities.filter("name is not null").select("question_id", F.upper(F.trim("name")).alias("name")).distinct()
    d = cut(G.degrees(GP.names(t), GP.edges(t)).select("name", F.col("degree").cast("double").alias("score")))
    return R.expand(e, d, GP.edges(t), limit=12)


@query()
def context_expand(t: Tables) -> DataFrame:
    return context(t)


@query()
def source_unit_support(t: Tables) -> DataFrame:
    m = t.query_entities.filter("name is not null").select(F.upper(F.trim("name")).alias("name"), F.col("question_id").alias("unit_id"))
    return R.source_units(context(t), m)


@query()
def context_text(t: Tables) -> DataFrame:
    return R.context_text(context(t), t.query_entities.filter("name is not null").select(F.upper(F.trim("name")).alias("name"), "description"))


@query("""
WITH one AS (SELECT qe_id, question_id, min(name) AS name, min(entity_type) AS type, min(description) AS description FROM query_entities GROUP BY 1, 2)
SELECT question_id, name AS a, coalesce(type, 'NONE') AS b, coalesce(description, '') AS c FROM one WHERE name IS NOT NULL
""")
def extraction_records(t: Tables) -> DataFrame:
    one = t.query_entities.groupBy("qe_id", "question_id").agg(F.min("name").alias("name"), F.min("entity_type").alias("type"), F.min("description").alias("description")).filter("name is not null")
    record = F.concat(F.lit('("entity"<|>"'), "name", F.lit('"<|>"'), F.coalesce("type", F.lit("NONE")), F.lit('"<|>"'), F.coalesce("description", F.lit("")), F.lit('")'))
    texts = one.groupBy("question_id").agg(F.concat(F.array_join(F.collect_list(record), "##"), F.lit("<|COMPLETE|>")).alias("text"))
    return R.parse_tuples(texts, "question_id").select("question_id", "a", "b", "c")


@query()
def seeded_sample(t: Tables) -> DataFrame:
    """A sampling operator: the 40 vertices first by seeded hash, vertices of type phase before the rest."""
    v = GP.vertices(t)
    return v.orderBy(F.coalesce(F.col("type") == "phase", F.lit(False)).desc(), F.xxhash64("name", F.lit(42)), "name").limit(40).select("name", "type")
