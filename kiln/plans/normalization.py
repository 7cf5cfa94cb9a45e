"""Queries on normalisation, terms and lemmas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators import normalization as N
from kiln.plans.base import Tables, query
from kiln.plans.cleaning import CHUNKS, chunks

WORDS = rf"(SELECT chunk_id, book, unnest(regexp_extract_all(text, '\p{{L}}+')) AS form FROM {CHUNKS})"


@query(rf"""
SELECT chunk_id, regexp_replace(regexp_replace(text, '([0-9]) ?(?:degrees? (?:Celsius|centigrade|C)|deg\.? C|Grad Celsius|градусов Цельсия|град\.?)([^\p{{L}}/]|$)', '\1 °C\2', 'g'), '([0-9]) ?° ?[CС]([^\p{{L}}/]|$)', '\1 °C\2', 'g') AS text
FROM {CHUNKS} WHERE regexp_matches(text, '[0-9] ?(?:°|deg|Grad|град)')
""")
def temperature_norm(t: Tables) -> DataFrame:
    c = chunks(t).filter(F.col("text").rlike(r"[0-9] ?(?:°|deg|Grad|град)"))
    return c.select("chunk_id", N.normalize(F.col("text"), N.TEMPERATURE[:2]).alias("text"))


@query(rf"""
SELECT chunk_id, regexp_replace(regexp_replace(text, '(?:kgf/mm2|kg/mm2|кгс/мм2|кГ/мм2|кгс/мм²)', 'kgf/mm²', 'g'), '(?:мкм|microns?|µm)([^\p{{L}}]|$)', 'μm\1', 'g') AS text FROM {CHUNKS} WHERE regexp_matches(text, 'kgf|kg/|кг|кГ|мкм|micron|µm')
""")
def unit_norm(t: Tables) -> DataFrame:
    return chunks(t).filter(F.col("text").rlike("kgf|kg/|кг|кГ|мкм|micron|µm")).select("chunk_id", N.normalize(F.col("text"), N.UNITS[1:3]).alias("text"))


@query(r"""
SELECT block_id, replace(replace(replace(text, '\sigma', 'σ'), '\gamma', 'γ'), '\varepsilon', 'ε') AS text FROM (SELECT DISTINCT block_id, text FROM blocks)
WHERE regexp_matches(text, '\\(sigma|gamma|varepsilon)') AND NOT regexp_matches(text, '\\(alpha|beta|delta|epsilon|lambda|mu|tau|omega|Delta)')
""")
def greek_norm(t: Tables) -> DataFrame:
    b = t.blocks.select("block_id", "text").distinct().filter(F.col("text").rlike(r"\\(sigma|gamma|varepsilon)") & ~F.col("text").rlike(r"\\(alpha|beta|delta|epsilon|lambda|mu|tau|omega|Delta)"))
    return b.select("block_id", N.normalize(F.col("text"), N.greek_rules()).alias("text"))


@query()
def greek_blocks(t: Tables) -> DataFrame:
    """Every block with all Greek macros replaced; greek_norm has those whose macros its SQL can say."""
    b = t.blocks.select("block_id", "text").distinct()
    return b.select("block_id", N.normalize(F.col("text"), N.greek_rules()).alias("text"))


@query()
def normalized_chunks(t: Tables) -> DataFrame:
    return chunks(t).select("chunk_id", N.normalize(F.col("text")).alias("text"))


@query()
def composition_dashes(t: Tables) -> DataFrame:
    return chunks(t).select("chunk_id", N.COMPOSITION.apply(F.col("text")).alias("fixed"), "text").filter("fixed <> text").select("chunk_id", "fixed")


@query("SELECT block_id, true AS same FROM (SELECT DISTINCT block_id, text FROM blocks) WHERE text IS NOT NULL")
def mask_round_trip(t: Tables) -> DataFrame:
    b = t.blocks.select("block_id", "text").distinct().filter("text is not null")
    marked, spans = N.mask(F.col("text"))
    return b.withColumn("m", marked).withColumn("s", spans).select("block_id", (N.unmask(F.col("m"), F.col("s")) == F.col("text")).alias("same"))


@query()
def term_annotation(t: Tables) -> DataFrame:
    return N.annotate(chunks(t), "chunk_id", {"аустенит": "austenite", "феррит": "ferrite", "Restaustenit": "retained austenite", "retained austenite": "austenite"}).filter("n > 0")


@query(rf"""
SELECT chunk_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}])Fig\.([^\p{{L}}\p{{N}}]|$)', '\1Figure\2', 'g') AS text FROM {CHUNKS} WHERE contains(text, 'Fig.') AND NOT regexp_matches(text, 'Fig\.[\p{{L}}\p{{N}}]')
""")
def abbreviations(t: Tables) -> DataFrame:
    return chunks(t).filter(F.col("text").contains("Fig.") & ~F.col("text").rlike(r"Fig\.[\p{L}\p{N}]")).select("chunk_id", N.expand(F.col("text"), {"Fig.": "Figure"}).alias("text"))


@query(f"SELECT lower(form) AS term, count(*) AS n FROM {WORDS} WHERE length(form) >= 4 GROUP BY 1 HAVING count(*) >= 3")
def term_discovery(t: Tables) -> DataFrame:
    return N.terms(chunks(t))


PLURALS = f"""
w AS (SELECT DISTINCT lower(form) AS word FROM {WORDS}),
p AS (SELECT word, unnest(CASE WHEN regexp_matches(word, 'ies$') THEN [regexp_replace(word, 'ies$', 'y')] WHEN regexp_matches(word, '(s|x|z|ch|sh)es$') THEN [regexp_replace(word, 'es$', ''), regexp_replace(word, 's$', '')]
  WHEN regexp_matches(word, '[^s]s$') THEN [regexp_replace(word, 's$', '')] ELSE [] END) AS lemma FROM w),
l AS (SELECT word, max_by(lemma, (length(lemma), lemma)) AS lemma FROM p WHERE lemma IN (FROM w) GROUP BY word)
"""


@query(f"WITH {PLURALS} SELECT word, lemma FROM l")
def plural_fold(t: Tables) -> DataFrame:
    return N.plurals(chunks(t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")))


@query(f"""
WITH {PLURALS}
SELECT chunk_id, form AS word, CASE WHEN form = upper(form) AND length(form) > 1 THEN upper(lemma) WHEN form[1] = upper(form[1]) THEN upper(lemma[1]) || lemma[2:] ELSE lemma END AS lemma, count(*) AS n
FROM {WORDS} f JOIN l ON l.word = lower(f.form) GROUP BY 1, 2, 3
""")
def lemmatized(t: Tables) -> DataFrame:
    c = chunks(t)
    lexicon = N.plurals(c.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")))
    return N.lemmatize(c, "chunk_id", lexicon)


@query(f"""
WITH {PLURALS}, h AS (SELECT f.book, count(*) AS n_words, count(l.lemma) AS n_changed, count(DISTINCT l.lemma) AS n_lemmas FROM {WORDS} f LEFT JOIN l ON l.word = lower(f.form) GROUP BY 1)
SELECT book, n_words, n_changed, n_lemmas FROM h
""")
def lemma_stats(t: Tables) -> DataFrame:
    words = chunks(t).select("book", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.join(N.plurals(words), "word", "left").groupBy("book").agg(F.count("*").alias("n_words"), F.count("lemma").alias("n_changed"), F.countDistinct("lemma").alias("n_lemmas"))


@query(rf"""
SELECT book, sum(len(regexp_extract_all(text, '[0-9] ?(?:°|deg|Grad|град|K(?:[^\p{{L}}]|$)|MPa|МПа|N/mm|Н/мм|kgf/mm|кгс/мм)')))::BIGINT AS n_units, sum(len(regexp_extract_all(text, '[0-9] (?:°C|N/mm²|kgf/mm²)')))::BIGINT AS n_canonical FROM {CHUNKS} GROUP BY book
""")
def canonical_share(t: Tables) -> DataFrame:
    return chunks(t).select("book", *N.unit_share(F.col("text"))).groupBy("book").agg(F.sum("n_units").alias("n_units"), F.sum("n_canonical").alias("n_canonical"))


@query(rf"""
WITH e AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents WHERE lang IS NOT NULL),
t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '\p{{L}}+')) AS word FROM entity_titles UNION SELECT unnest(['im', 'gilt', 'x', 'a']))
SELECT word FROM e WHERE word IN (FROM t) GROUP BY word HAVING count(*) = (SELECT count(DISTINCT lang) FROM e)
""")
def bridging_terms(t: Tables) -> DataFrame:
    titles = t.entity_titles.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).unionByName(t.spark.createDataFrame([("im",), ("gilt",), ("x",), ("a",)], "word string"))
    return N.in_every_group(t.documents.filter("lang is not null"), "lang", titles)


@query(rf"""
WITH w AS (SELECT DISTINCT chunk_id, lower(form) AS word FROM {WORDS})
SELECT e.title, count(DISTINCT c.chunk_id) AS n_chunks FROM entity_titles e JOIN {CHUNKS} c ON contains(lower(c.text), lower(e.title)) GROUP BY 1
""")
def glossary_coverage(t: Tables) -> DataFrame:
    """Titles are looked up by their word sequences: n-grams of the chunks meet the titles by equality, no text is held against every title."""
    titles = t.entity_titles.select("title", F.lower("title").alias("k")).distinct()
    first = titles.withColumn("w", F.regexp_extract("k", r"^\p{L}+", 0))
    c = chunks(t).select("chunk_id", F.lower("text").alias("low"))
    # A title that stands within a longer word is found by the words that end with its first word.
    words = c.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    lengths = [r.n for r in first.select(F.length("w").alias("n")).distinct().orderBy("n").collect()]
    tails = words.select("chunk_id", F.explode(F.array_distinct(F.array(*[F.expr(f"right(word, {n})") for n in lengths]))).alias("w")).distinct() if lengths else words.withColumnRenamed("word", "w")
    met = tails.join(first, "w").join(c, "chunk_id").filter(F.contains("low", "k"))
    return met.groupBy("title").agg(F.countDistinct("chunk_id").alias("n_chunks"))
