"""Queries on block structure and boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions import text as T
from kiln.operators import blocks as B
from kiln.operators import scans
from kiln.plans.base import Tables, query

ENDS = r"(regexp_matches({0}, '[.!?:;…][\"»”)]?\s*$|\$\$\s*$|</table>\s*$'))"
STRICT = "(" + ENDS + r" AND NOT regexp_matches({0}, '(^| )(Fig|al|No|vs|cf|рис|табл|др|Abb|Bd|\p{{Lu}})\.\s*$'))"
MID = r"regexp_matches({0}, '^[\p{{Ll}}0-9$]')"
TAIL = r"regexp_matches({0}, '(^| )(" + "|".join(T.FUNCTION_WORDS) + r")\s*$')"
CONT = "(NOT " + STRICT.format("{0}") + " AND (" + MID.replace("{0}", "{1}") + r" OR regexp_matches({0}, '-\s*$') OR " + TAIL + "))"
DISTINCT_BLOCKS = "(SELECT DISTINCT block_id, chunk_id, book, idx, kind, text, start_pos, end_pos FROM blocks)"


def cont(left: str, right: str) -> str:
    return CONT.replace("{{", "{").replace("}}", "}").replace("{0}", left).replace("{1}", right)


def strict(x: str) -> str:
    return STRICT.replace("{{", "{").replace("}}", "}").replace("{0}", x)


def ends(x: str) -> str:
    return ENDS.replace("{0}", x)


def distinct_blocks(t: Tables) -> DataFrame:
    return t.blocks.select("block_id", "chunk_id", "book", "idx", "kind", "text", "start_pos", "end_pos").distinct()


def segmented(df: DataFrame) -> DataFrame:
    """Adds segment: a prefix of the chunk id, so that a book is scanned in stretches of some hundred chunks."""
    return df.withColumn("segment", F.substr("chunk_id", F.lit(1), F.greatest(F.length("chunk_id") - 2, F.lit(1))))


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
o AS (SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_pos FROM p)
SELECT doc_id, idx::INT AS idx, part AS text, start_pos, (start_pos + length(part))::INT AS end_pos FROM o WHERE trim(part) <> ''
""")
def block_split(t: Tables) -> DataFrame:
    return B.split_blocks(t.documents, "doc_id")


@query(r"""
SELECT block_id, CASE WHEN text IS NULL THEN NULL
  WHEN regexp_matches(text, '^#{1,6} ') AND NOT regexp_matches(regexp_replace(text, '^#{1,6} ', ''), '^(Fig\.|Figure|Table|Рис\.|Таблица|Bild|Tabelle) ?[0-9]+') THEN 'heading'
  WHEN starts_with(text, '$$') THEN 'formula' WHEN starts_with(text, '<table') THEN 'table' WHEN starts_with(text, '![') THEN 'image' ELSE 'paragraph' END AS block_kind
FROM (SELECT DISTINCT block_id, text FROM blocks)
""")
def block_kind(t: Tables) -> DataFrame:
    return t.blocks.select("block_id", "text").distinct().select("block_id", T.block_kind(F.col("text")).alias("block_kind"))


@query("""
WITH l AS (SELECT book, trim(unnest(string_split(text, chr(10)))) AS line FROM chunks)
SELECT book, line, count(*) AS n FROM l WHERE line <> '' AND NOT starts_with(line, '$$') AND length(line) <= 80 GROUP BY 1, 2 HAVING count(*) >= 3
""")
def running_headers(t: Tables) -> DataFrame:
    return B.furniture(t.chunks, "book")


@query(r"""
SELECT book, count(*) AS n_blocks, count(*) FILTER (regexp_matches(text, '^[-—·]? ?[0-9]{1,3} ?[-—·]?$') OR starts_with(text, '<small>')) AS n_page_numbers
FROM blocks WHERE text IS NOT NULL GROUP BY book
""")
def page_number_blocks(t: Tables) -> DataFrame:
    return t.blocks.filter("text is not null").groupBy("book").agg(F.count("*").alias("n_blocks"), F.count_if(B.is_furniture(F.col("text"))).alias("n_page_numbers"))


@query(r"""
SELECT book, count(*) FILTER (c) AS n_captions, count(*) FILTER (NOT c AND coalesce(kind, 'paragraph') IN ('paragraph', 'formula', 'table')) AS n_body
FROM (SELECT book, kind, regexp_matches(text, '^(Fig\.|Figure|Table|Рис\.|Таблица|Bild|Tabelle) ?[0-9]+') AS c FROM blocks WHERE text IS NOT NULL) GROUP BY book
""")
def caption_body(t: Tables) -> DataFrame:
    c = F.col("text").rlike(T.CAPTION)
    body = ~c & F.coalesce("kind", F.lit("paragraph")).isin("paragraph", "formula", "table")
    return t.blocks.filter("text is not null").groupBy("book").agg(F.count_if(c).alias("n_captions"), F.count_if(body).alias("n_body"))


@query(f"""
SELECT block_id, {ends('text')} AS ends_sentence, {strict('text')} AS ends_strictly FROM {DISTINCT_BLOCKS} WHERE text IS NOT NULL
""")
def sentence_boundaries(t: Tables) -> DataFrame:
    return distinct_blocks(t).filter("text is not null").select("block_id", T.ends_sentence(F.col("text")).alias("ends_sentence"), T.ends_strictly(F.col("text")).alias("ends_strictly"))


@query(f"""
WITH n AS (SELECT *, lead(text) OVER (PARTITION BY chunk_id ORDER BY idx, block_id) AS next_text FROM {DISTINCT_BLOCKS})
SELECT block_id, chunk_id FROM n WHERE next_text IS NOT NULL AND ({cont('text', 'next_text')} OR regexp_matches(text, '\\p{{L}}-$'))
""")
def broken_paragraphs(t: Tables) -> DataFrame:
    return B.broken_pairs(distinct_blocks(t), "chunk_id", ["idx", "block_id"]).select("block_id", "chunk_id")


@query(f"""
WITH n AS (SELECT *, lead(text) OVER w AS rt, lead(kind) OVER w AS rk FROM {DISTINCT_BLOCKS} WINDOW w AS (PARTITION BY book ORDER BY chunk_id, idx, block_id))
SELECT book, count(*) AS n_pairs, count(*) FILTER (CASE WHEN rk = 'heading' THEN kind <> 'image' AND {ends('text')} WHEN kind = 'image' OR rk = 'formula' THEN false
  WHEN kind IN ('formula', 'table') THEN NOT regexp_matches(rt, '^[\\p{{Ll}}0-9$]') ELSE NOT {cont('text', 'rt')} END) AS n_clean
FROM (SELECT book, coalesce(kind, 'paragraph') AS kind, text, coalesce(rk, 'paragraph') AS rk, rt FROM n WHERE rt IS NOT NULL AND text IS NOT NULL) GROUP BY book
""")
def clean_cuts(t: Tables) -> DataFrame:
    n = scans.neighbour(segmented(distinct_blocks(t)), "book", "segment", ["chunk_id", "idx", "block_id"], {"rt": F.col("text"), "rk": F.col("kind")})
    n = n.withColumn("rk", F.coalesce("rk", F.lit("paragraph"))).filter("rt is not null and text is not null")
    cut = B.clean_cut(F.coalesce("kind", F.lit("paragraph")), F.col("text"), F.col("rk"), F.col("rt"))
    return n.groupBy("book").agg(F.count("*").alias("n_pairs"), F.count_if(cut).alias("n_clean"))


@query(r"""
WITH f AS (SELECT block_id, unnest(regexp_extract_all(text, '\$\$[^$]+\$\$|\$[^$\n]+\$')) AS formula FROM (SELECT DISTINCT block_id, text FROM blocks))
SELECT block_id, formula, count(*) AS n FROM f WHERE NOT regexp_matches(formula, '^\$\^\{[0-9, ]+\}\$$') GROUP BY 1, 2
""")
def formulas(t: Tables) -> DataFrame:
    f = t.blocks.select("block_id", "text").distinct().select("block_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$\$[^$]+\$\$|\$[^$\n]+\$"), F.lit(0))).alias("formula"))
    return f.filter(~F.col("formula").rlike(r"^\$\^\{[0-9, ]+\}\$$")).groupBy("block_id", "formula").agg(F.count("*").alias("n"))


@query(r"""
WITH c AS (SELECT block_id, trim(unnest(regexp_extract_all(text, '<td>([^<]*)</td>', 1))) AS cell FROM (SELECT DISTINCT block_id, text FROM blocks))
SELECT block_id, cell, count(*) AS n FROM c WHERE cell <> '' GROUP BY 1, 2
""")
def table_cells(t: Tables) -> DataFrame:
    c = t.blocks.select("block_id", "text").distinct().select("block_id", F.explode(F.regexp_extract_all("text", F.lit("<td>([^<]*)</td>"), F.lit(1))).alias("cell")).withColumn("cell", F.trim("cell"))
    return c.filter("cell <> ''").groupBy("block_id", "cell").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) > 0.3 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) THEN 'ru' ELSE 'en' END AS guess FROM documents
""")
def lang_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.language(F.col("text")).alias("guess"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+|[0-9]+|[^\p{L}0-9\s]'))::INT AS n_tokens FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(r"""
WITH m AS (SELECT chunk_id, text, regexp_extract(text, '(?s)^(.*?)\n\n(Fig\.|Table|Рис\.|Таблица|Bild) ', 1) AS head FROM (SELECT DISTINCT chunk_id, text FROM chunks))
SELECT chunk_id, rtrim(head) || chr(10) AS body FROM m WHERE head <> ''
""")
def cut_at_pattern(t: Tables) -> DataFrame:
    head = F.regexp_extract("text", r"(?s)^(.*?)\n\n(Fig\.|Table|Рис\.|Таблица|Bild) ", 1)
    return t.chunks.select("chunk_id", "text").distinct().select("chunk_id", F.concat(F.rtrim(head), F.lit("\n")).alias("body")).filter("body <> '\n'")


@query(f"""
WITH l AS (SELECT book, trim(unnest(string_split(text, chr(10)))) AS line FROM chunks),
h AS (SELECT book, line FROM l WHERE line <> '' AND NOT starts_with(line, '$$') AND length(line) <= 80 GROUP BY 1, 2 HAVING count(*) >= 3),
w AS (SELECT *, bool_or(coalesce(kind = 'heading' AND regexp_matches(trim(text), '(?i)^(references|литература|literatur)$'), false)) OVER o AS refs,
  coalesce(last_value(CASE WHEN kind = 'heading' THEN lower(trim(text)) IN ('surface quality', 'kühlstrategie') END IGNORE NULLS) OVER o, false) AS dropped
  FROM {DISTINCT_BLOCKS} WINDOW o AS (PARTITION BY book ORDER BY chunk_id, idx, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT CASE WHEN refs THEN 'reference_list' WHEN dropped THEN 'dropped_section' WHEN coalesce(kind, '') = 'image' AND regexp_matches(text, '^!\\[\\]') THEN 'image_placeholder'
  WHEN starts_with(text, '<small>') THEN 'page_footnote' WHEN h.line IS NOT NULL THEN 'running_header' WHEN regexp_matches(text, '^[-—·]? ?[0-9]{{1,3}} ?[-—·]?$') THEN 'page_number'
  WHEN regexp_matches(text, '(?i)^(doi|issn|udc|УДК)[ :]') THEN 'metadata_block' END AS rule FROM w LEFT JOIN h ON h.book = w.book AND h.line = trim(w.text))
SELECT coalesce(rule, 'kept') AS rule, count(*) AS n FROM r GROUP BY 1
""")
def deletion_cascade(t: Tables) -> DataFrame:
    cascade = B.delete_cascade(segmented(distinct_blocks(t)), "book", ["chunk_id", "idx", "block_id"], B.furniture(t.chunks, "book"), ["surface quality", "kühlstrategie"], segment="segment")
    return cascade.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


@query(f"""
WITH o AS (SELECT *, (kind = 'heading' AND coalesce(lag(kind) OVER w, '') <> 'heading')::INT AS opens, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM {DISTINCT_BLOCKS} WINDOW w AS (PARTITION BY book ORDER BY chunk_id, idx, block_id))
SELECT block_id, section, sum(opens) OVER (PARTITION BY book ORDER BY chunk_id, idx, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS section_no FROM o
""")
def section_state(t: Tables) -> DataFrame:
    return B.sections(segmented(distinct_blocks(t)), "book", ["chunk_id", "idx", "block_id"], segment="segment").select("block_id", "section", "section_no")


@query()
def merged_paragraphs(t: Tables) -> DataFrame:
    return B.merge_broken(distinct_blocks(t).filter("text is not null"), "chunk_id", ["idx", "block_id"])


@query()
def markdown_blocks(t: Tables) -> DataFrame:
    return B.parse_markdown(t.chunks.select("chunk_id", "text").distinct(), "chunk_id")


@query("""
SELECT b.block_id, (substr(c.text, b.start_pos + 1, b.end_pos - b.start_pos) = b.text) AS round_trip
FROM (SELECT DISTINCT block_id, chunk_id, text, start_pos, end_pos FROM blocks) b JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1 HAVING count(DISTINCT text) = 1) c USING (chunk_id)
""")
def span_round_trip(t: Tables) -> DataFrame:
    one = t.chunks.groupBy("chunk_id").agg(F.min("text").alias("whole"), F.countDistinct("text").alias("k")).filter("k = 1")
    b = t.blocks.select("block_id", "chunk_id", "text", "start_pos", "end_pos").distinct().join(one, "chunk_id")
    return b.select("block_id", (F.substr("whole", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) == F.col("text")).alias("round_trip"))
