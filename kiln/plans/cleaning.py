"""Queries on cleaning rules, their audit and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions import text as T
from kiln.operators import cleaning as C
from kiln.plans.base import Tables, query

CHUNKS = "(SELECT DISTINCT chunk_id, book, text FROM chunks)"
AUDIT = "(SELECT DISTINCT audit_id, chunk_id, rule_name, before_text, after_text FROM audit_log)"


def chunks(t: Tables) -> DataFrame:
    return t.chunks.select("chunk_id", "book", "text").distinct()


def audit_rows(t: Tables) -> DataFrame:
    return t.audit_log.select("audit_id", "chunk_id", "rule_name", "before_text", "after_text").distinct()


@query(r"""
WITH w AS (SELECT book, unnest(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*')) AS word FROM (SELECT DISTINCT chunk_id, book, text FROM chunks))
SELECT book, word, count(*) AS n FROM w GROUP BY 1, 2
""")
def book_vocabulary(t: Tables) -> DataFrame:
    return C.vocabulary(chunks(t), "book")


@query(r"""
WITH w AS (SELECT book, unnest(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*')) AS word FROM (SELECT DISTINCT chunk_id, book, text FROM chunks))
SELECT book, word, count(*) AS n FROM w WHERE contains(word, '-') GROUP BY 1, 2
""")
def hyphen_compounds(t: Tables) -> DataFrame:
    return C.compounds(chunks(t), "book")


@query(rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+(?:-\p{{L}}+)*')) AS word FROM {CHUNKS}),
p AS (SELECT chunk_id, unnest(regexp_extract_all(text, '(\p{{L}}+)[-¬]\n\s*(\p{{L}}+)', 1)) AS l, unnest(regexp_extract_all(text, '(\p{{L}}+)[-¬]\n\s*(\p{{L}}+)', 2)) AS r FROM {CHUNKS})
SELECT chunk_id, l AS "left", r AS "right", CASE WHEN lower(r) IN ('and', 'or', 'und', 'oder', 'и', 'или', 'а') THEN 'keep_tail' WHEN lower(l || '-' || r) IN (FROM w) THEN 'hyphen'
  WHEN lower(l || r) IN (FROM w) THEN 'join' WHEN regexp_matches(r, '^[а-яё]') THEN 'join' ELSE 'keep' END AS decision FROM p
""")
def dehyphenation(t: Tables) -> DataFrame:
    return C.join_breaks(chunks(t), "chunk_id", C.vocabulary(chunks(t), "book"))


@query(f"SELECT chunk_id, nfc_normalize(text) AS text FROM {CHUNKS}")
def normal_forms(t: Tables) -> DataFrame:
    return C.normal_form(chunks(t), "chunk_id")


@query(rf"""
SELECT chunk_id, length(text) - length(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g')) AS n_removed FROM {CHUNKS}
""")
def control_characters(t: Tables) -> DataFrame:
    return chunks(t).select("chunk_id", (F.length("text") - F.length(C.CLEANING[0].apply(F.col("text")))).cast("long").alias("n_removed"))


@query(f"SELECT chunk_id, replace(replace(text, 'deg C', '°C'), 'град.', '°C') AS fixed FROM {CHUNKS} WHERE contains(text, 'deg C') OR contains(text, 'град.')")
def literal_fixes(t: Tables) -> DataFrame:
    rules = [C.Rule("deg", "deg C", "°C", True), C.Rule("grad", "град.", "°C", True)]
    hit = F.col("text").contains("deg C") | F.col("text").contains("град.")
    return C.clean(chunks(t).filter(hit), "chunk_id", rules=rules).select("chunk_id", F.col("clean").alias("fixed"))


@query(rf"""
SELECT audit_id, regexp_replace(before_text, ' ?\[[0-9]+(?:, ?[0-9]+)*\]', '', 'g') AS clean FROM {AUDIT} WHERE before_text IS NOT NULL AND regexp_matches(before_text, '\[[0-9]+(?:, ?[0-9]+)*\]')
""")
def citation_removal(t: Tables) -> DataFrame:
    return C.clean(audit_rows(t).filter(F.col("before_text").rlike(r"\[[0-9]+(?:, ?[0-9]+)*\]")), "audit_id", "before_text", [C.CLEANING[1]]).select("audit_id", "clean")


@query(rf"""
SELECT block_id, regexp_replace(regexp_replace(text, '</?(?:b|i|em|strong|span|p|sup|sub|u|font)(?: [^<>]*)?>', '', 'g'), '\\([_*#&%])', '\1', 'g') AS clean
FROM (SELECT DISTINCT block_id, text FROM blocks) WHERE regexp_matches(text, '</?(?:b|i|em|strong|span|p|sup|sub|u|font)(?: [^<>]*)?>|\\[_*#&%]')
""")
def markup_and_escapes(t: Tables) -> DataFrame:
    b = t.blocks.select("block_id", "text").distinct().filter(F.col("text").rlike(C.CLEANING[4].pattern + r"|\\[_*#&%]"))
    return C.clean(b, "block_id", rules=C.CLEANING[4:6]).select("block_id", "clean")


@query(rf"""
SELECT audit_id, trim(regexp_replace(regexp_replace(before_text, '[ \t]+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g')) AS clean FROM {AUDIT} WHERE before_text IS NOT NULL
""")
def whitespace_norm(t: Tables) -> DataFrame:
    return audit_rows(t).filter("before_text is not null").select("audit_id", T.squeeze(F.col("before_text")).alias("clean"))


@query()
def math_noise(t: Tables) -> DataFrame:
    return C.clean(chunks(t), "chunk_id", rules=C.CLEANING[7:9]).filter(F.col("clean") != F.col("text")).select("chunk_id", "clean")


@query()
def outside_math(t: Tables) -> DataFrame:
    return C.outside_math(chunks(t), "chunk_id", lambda x: F.lower(x)).select("chunk_id", "rewritten")


@query()
def cleaned_chunks(t: Tables) -> DataFrame:
    return C.clean(chunks(t), "chunk_id").select("chunk_id", "clean")


@query()
def audit_capture(t: Tables) -> DataFrame:
    return C.audit(chunks(t), "chunk_id")


@query(f"SELECT coalesce(rule_name, 'none') AS rule, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM {AUDIT} GROUP BY 1")
def rule_histogram(t: Tables) -> DataFrame:
    return audit_rows(t).groupBy(F.coalesce("rule_name", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


NUMBERS = "SELECT audit_id, replace(unnest(regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)?')), ',', '.') AS number FROM " + AUDIT + " WHERE after_text IS NOT NULL"


@query(f"SELECT audit_id, number, count(*) AS n FROM (({NUMBERS.format('before_text')}) EXCEPT ALL ({NUMBERS.format('after_text')})) GROUP BY 1, 2")
def numbers_lost(t: Tables) -> DataFrame:
    a = audit_rows(t).filter("after_text is not null")
    return C.numbers(a, "audit_id", "before_text").exceptAll(C.numbers(a, "audit_id", "after_text")).groupBy("audit_id", "number").agg(F.count("*").alias("n"))


@query(f"SELECT audit_id, number, count(*) AS n FROM (({NUMBERS.format('before_text')}) INTERSECT ALL ({NUMBERS.format('after_text')})) GROUP BY 1, 2")
def numbers_kept(t: Tables) -> DataFrame:
    a = audit_rows(t).filter("after_text is not null")
    return C.numbers(a, "audit_id", "before_text").intersectAll(C.numbers(a, "audit_id", "after_text")).groupBy("audit_id", "number").agg(F.count("*").alias("n"))


MEASURES = r"""
SELECT chunk_id, length(text)::INT AS n_chars, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'))::INT AS n_numbers, len(regexp_extract_all(text, '\$[^$\n]+\$'))::INT AS n_formulas, len(regexp_extract_all(text, '<td>'))::INT AS n_cells,
  len(regexp_extract_all(text, '\[[0-9]+(?:, ?[0-9]+)*\]'))::INT AS n_citations, len(regexp_extract_all(text, '</?[a-z]+>'))::INT AS n_tags, len(regexp_extract_all(text, '\p{Ll}[-¬]\n'))::INT AS n_breaks,
  len(regexp_extract_all(text, '[\p{L}0-9._-]+@[\p{L}0-9-]+\.[a-z]+'))::INT AS n_emails, len(regexp_extract_all(text, '\+?[0-9]{1,3}[ (-]+[0-9]{3}[ )-]+[0-9]{3}[- ]?[0-9]{2}'))::INT AS n_phones,
  len(regexp_extract_all(text, '\p{Lu}\. ?\p{Lu}\. \p{Lu}\p{Ll}+'))::INT AS n_names FROM """ + CHUNKS


@query(MEASURES)
def text_measures(t: Tables) -> DataFrame:
    return chunks(t).select("chunk_id", *C.text_measures(F.col("text")))


@query(f"WITH m AS ({MEASURES}) SELECT chunk_id, n_emails + n_phones + n_names AS n_personal FROM m WHERE n_emails + n_phones + n_names > 0")
def personal_data(t: Tables) -> DataFrame:
    m = chunks(t).select("chunk_id", *C.text_measures(F.col("text")))
    return m.select("chunk_id", (F.col("n_emails") + F.col("n_phones") + F.col("n_names")).alias("n_personal")).filter("n_personal > 0")


@query(f"WITH m AS ({MEASURES}) SELECT chunk_id, n_citations + n_tags + n_breaks AS n_marks FROM m")
def service_marks(t: Tables) -> DataFrame:
    m = chunks(t).select("chunk_id", *C.text_measures(F.col("text")))
    return m.select("chunk_id", (F.col("n_citations") + F.col("n_tags") + F.col("n_breaks")).alias("n_marks"))


@query()
def noise_share(t: Tables) -> DataFrame:
    return C.noise_characters(chunks(t), "chunk_id", [r"!\[[^\]]*\]\([^)]*\)", r"</?[a-z][^<>]*>", r"\\[a-z]+", r"\[[0-9]+(?:, ?[0-9]+)*\]", r"[\x00-\x08]", r"\{\{[^}]*\}\}", r"^[-—·] ?[0-9]+ ?[-—·]$"])


@query(rf"""
WITH m AS (SELECT book, chunk_id, length(text) AS c, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) AS k FROM {CHUNKS})
SELECT book, grouping(book)::INT AS total, count(*) AS n_chunks, sum(c)::BIGINT AS n_chars, sum(k)::BIGINT AS n_numbers, round(sum(k) / sum(c)::DOUBLE, 8) AS numbers_per_char,
  round(sum(c * k) / sum(c)::DOUBLE, 6) AS weighted_numbers FROM m GROUP BY ROLLUP (book)
""")
def metrics_rollup(t: Tables) -> DataFrame:
    m = chunks(t).select("book", F.length("text").alias("c"), F.regexp_count("text", F.lit(T.NUMBER)).alias("k"))
    return m.rollup("book").agg(F.grouping("book").cast("int").alias("total"), F.count("*").alias("n_chunks"), F.sum("c").alias("n_chars"), F.sum("k").alias("n_numbers"), F.round(F.sum("k") / F.sum("c"), 8).alias("numbers_per_char"), F.round(F.sum(F.col("c") * F.col("k")) / F.sum("c"), 6).alias("weighted_numbers"))


@query()
def changed_words(t: Tables) -> DataFrame:
    return C.changed_words(audit_rows(t).filter("after_text is not null and before_text is not null"), "audit_id", "before_text", "after_text")


@query(rf"""
SELECT rule_name, count(*) AS n, sum(len(regexp_extract_all(after_text, '\p{{L}}+')) - len(regexp_extract_all(before_text, '\p{{L}}+')))::BIGINT AS words_added,
  count(*) FILTER (before_text <> after_text) AS n_changed FROM {AUDIT} WHERE after_text IS NOT NULL AND before_text IS NOT NULL AND rule_name IS NOT NULL GROUP BY 1
""")
def audit_effects(t: Tables) -> DataFrame:
    a = audit_rows(t).filter("after_text is not null and before_text is not null and rule_name is not null")
    n = lambda c: F.regexp_count(c, F.lit(r"\p{L}+"))
    return a.groupBy("rule_name").agg(F.count("*").alias("n"), F.sum(n("after_text") - n("before_text")).alias("words_added"), F.count_if(F.col("before_text") != F.col("after_text")).alias("n_changed"))


@query("""
WITH d AS (SELECT DISTINCT text FROM chunks), k AS (SELECT text, count(*) AS n, count(DISTINCT chunk_id) AS ids FROM chunks GROUP BY text HAVING count(*) > 1)
SELECT md5(text) AS text_key, n, ids FROM k
""")
def duplicate_groups(t: Tables) -> DataFrame:
    return t.chunks.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids")).filter("n > 1").select(F.md5("text").alias("text_key"), "n", "ids")
