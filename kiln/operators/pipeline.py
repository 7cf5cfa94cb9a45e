"""Stages composed of the operators: cleaning of a book from its blocks, normalisation in twelve steps, and the evaluation of a graph.

Defined results: a step that meets nothing changes nothing; blocks of null text are deleted as empty; a group without blocks has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators import blocks as B
from kiln.operators import cleaning as C
from kiln.operators import graph as G
from kiln.operators import normalization as N
from kiln.operators import quality as Q
from kiln.session import cut

#: Sections that a clean book goes without.
DROPPED = ["acknowledgements", "благодарности", "danksagung"]


def clean_book(blocks: DataFrame, group: str, order: list[str], headers: DataFrame, literals: list[C.Rule] = (), dropped: list[str] = DROPPED) -> tuple[DataFrame, DataFrame]:
    """((group, paragraph, text, n_parts), (group, rule, before, n)): blocks deleted by the cascade, broken paragraphs merged, rewritten by the rules, empty ones dropped; and the audit of deletions, merges and rewrites."""
    marked = cut(B.delete_cascade(blocks.withColumn("text", F.coalesce("text", F.lit(""))), group, order, headers, dropped))
    merged = cut(B.merge_broken(marked.filter("rule is null"), group, order))
    rules = [*literals, *C.CLEANING]
    clean = C.clean(merged, group, rules=rules).select(group, "paragraph", F.trim("clean").alias("text"), "n_parts").filter("text <> ''")
    deleted = marked.filter("rule is not null").groupBy(group, "rule", F.col("text").alias("before")).agg(F.count("*").alias("n"))
    joined = merged.filter("n_parts > 1").groupBy(group, F.lit("merged_paragraph").alias("rule"), F.col("text").alias("before")).agg(F.count("*").alias("n"))
    fired = C.audit(merged.withColumn("at", F.struct(group, "paragraph")), "at", rules=rules).groupBy(F.col(f"at.{group}").alias(group), "rule", "before").agg(F.sum("n").alias("n"))
    return clean, deleted.unionByName(joined).unionByName(fired)


def normalize_text(texts: DataFrame, key: str, lexicon: DataFrame, terms: dict[str, str], abbreviations: dict[str, str], literals: list[C.Rule] = (), text: str = "text") -> DataFrame:
    """(key, text): literal fixes, critical points, units of headers, temperatures, Greek letters, units, composition dashes; then with formulas and tables masked: lemmas, annotated terms, abbreviations written out; and the masks taken off."""
    step = F.col(text)
    for rule in [*literals, N.CRITICAL, N.HEADER_UNIT, *N.TEMPERATURE, *N.greek_rules(), *N.UNITS, N.COMPOSITION]:
        step = rule.apply(step)
    marked, spans = N.mask(F.col(text))
    rows = cut(texts.select(key, step.alias(text)).select(key, marked.alias(text), spans.alias("spans")))
    lemmas = N.relemmatize(rows, key, lexicon, text)
    noted = N.annotate(lemmas, key, terms, text)
    out = noted.select(key, N.expand(F.col(text), abbreviations).alias(text)).join(rows.select(key, "spans"), key)
    return out.select(key, N.unmask(F.col(text), F.coalesce("spans", F.array().cast("array<string>"))).alias(text))


def evaluate_graph(vertices: DataFrame, edges: DataFrame, terms: DataFrame, mentions: DataFrame) -> DataFrame:
    """(criterion, value): size, connection, completeness, coreference, noise and formulas of a graph, a row each. vertices: (name, type, lang); terms: (term); mentions: (name, unit_id). Formula vertices count neither as noise nor as duplicates."""
    from kiln.operators import similarity as S

    v, e = cut(vertices.groupBy("name").agg(F.min("type").alias("type"), F.min("lang").alias("lang"))), cut(edges)
    names = v.select("name")
    plain = names.filter(~F.coalesce(Q.is_formula(F.col("name")), F.lit(False)))
    row = lambda name, c: c.alias(name)
    parts = [
        G.degrees(names, e).agg(row("vertices", F.count("*")), row("mean_degree", F.avg("degree")), row("isolated", F.count_if(F.col("degree") == 0)), row("leaves", F.count_if(F.col("degree") == 1))),
        G.both(e).filter("src < dst").agg(row("edges", F.count("*"))),
        G.components(names, e).groupBy("component").agg(F.count("*").alias("n")).agg(row("components", F.count("*")), row("largest_share", F.max("n") / F.sum("n"))),
        G.clustering(names, e).agg(row("clustering", F.avg("clustering")), row("triangles", F.sum("triangles") / 3)),
        names.agg(row("formulas", F.count_if(Q.is_formula(F.col("name"))))),
        plain.agg(row("noise", F.count_if(F.size(Q.noise_labels(F.col("name"))) > 0))),
        Q.duplicate_names(plain).agg(row("duplicate_groups", F.count("*")), row("duplicate_names", F.coalesce(F.sum("n"), F.lit(0)))),
        S.coreferent(plain).agg(row("similar_pairs", F.count_if(~F.col("cross"))), row("translated_pairs", F.count_if(F.col("cross")))),
        S.coverage(terms, names).agg(row("completeness_exact", F.avg(F.col("lexical").cast("double"))), row("completeness_similar", F.avg(F.col("similar").cast("double")))),
        mentions.join(names, "name", "left_semi").groupBy("name").agg(F.countDistinct("unit_id").alias("n")).agg(row("mentioned", F.count("*")), row("mean_units", F.avg("n"))),
    ]
    out = None
    for p in parts:
        long = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value")) for c in p.columns])).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out
