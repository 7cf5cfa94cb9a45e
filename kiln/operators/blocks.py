"""Block structure: split into blocks with offsets, furniture, boundaries, sections.

Defined results: null text gives no blocks; an empty text gives none; ties and repeats keep every occurrence with its own offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions import text as T
from kiln.operators import scans


def split_blocks(docs: DataFrame, key: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """(key, idx, text, start_pos, end_pos): non-blank pieces between separators, half-open offsets in code points of the whole text."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), separator, -1)).alias("idx", "part"))
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("part") + len(separator)).over(w), F.lit(0)).cast("int")
    return parts.withColumn("start_pos", at).filter(F.trim("part") != "").select(key, "idx", F.col("part").alias("text"), "start_pos", (F.col("start_pos") + F.length("part")).alias("end_pos"))


def parse_markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, kind, text, start_pos, end_pos) by the full line grammar: a line that is $$ opens and closes a formula whose blank lines stay inside; blank lines part all else."""

    def blocks(t: str) -> Iterator[tuple[int, int]]:
        at, begin, end, formula = 0, None, 0, False
        for line in t.split("\n"):
            stop = at + len(line)
            if line.strip() == "$$":
                if formula:
                    yield begin, stop
                    begin, formula = None, False
                else:
                    if begin is not None:
                        yield begin, end
                    begin, formula = at, True
            elif not line.strip() and not formula:
                if begin is not None:
                    yield begin, end
                begin = None
            else:
                begin = at if begin is None else begin
            end, at = stop, stop + 1
        if begin is not None:
            yield begin, end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                for i, (x, y) in enumerate(blocks(t or "")):
                    raw = t[x:y]
                    x, y = x + len(raw) - len(raw.lstrip()), y - (len(raw) - len(raw.rstrip()))
                    out.append((k, i, t[x:y], x, y))
            yield pd.DataFrame(out, columns=[key, "idx", "text", "start_pos", "end_pos"])

    kind = dict(docs.dtypes)[key]
    out = docs.select(key, text).mapInPandas(run, f"{key} {kind}, idx int, text string, start_pos int, end_pos int")
    return out.select(key, "idx", T.block_kind(F.col("text")).alias("kind"), "text", "start_pos", "end_pos")


def furniture(docs: DataFrame, group: str, text: str = "text", repeats: int = 3, longest: int = 80) -> DataFrame:
    """(group, line, n): stripped lines of at most longest characters that stand repeats times or more in a group and open no formula."""
    lines = docs.select(group, F.explode(F.split(F.col(text), "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.filter("line <> '' and not startswith(line, '$$')").filter(F.length("line") <= longest).groupBy(group, "line").agg(F.count("*").alias("n")).filter(F.col("n") >= repeats)


def is_furniture(text: Column) -> Column:
    """Page numbers and small print; running headers come from furniture()."""
    return text.rlike(T.PAGE_NUMBER) | text.startswith("<small>")


def adjacent(blocks: DataFrame, group: str, order: list[str], text: str = "text") -> DataFrame:
    """Each block beside the next of its group: next_text."""
    return blocks.withColumn("next_text", F.lead(text).over(Window.partitionBy(group).orderBy(*order)))


def broken_pairs(blocks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Pairs of neighbours whose right side carries the left one on, or whose left side ends in a hyphen."""
    pairs = adjacent(blocks, group, order).filter("next_text is not null")
    return pairs.filter(T.continues(F.col("text"), F.col("next_text")) | F.col("text").rlike(r"\p{L}-$"))


def sections(blocks: DataFrame, group: str, order: list[str], segment: str | None = None) -> DataFrame:
    """Adds section_no and section: a section begins at a heading that follows other content; the heading names what comes after it. segment: a column in the order's sense that parts large groups."""
    rows, seg = (blocks, segment) if segment else (blocks.withColumn("_seg", F.lit(0)), "_seg")
    before = scans.neighbour(rows, group, seg, order, {"_kind": F.col("kind")}, ahead=False)
    opens = ((F.col("kind") == "heading") & (F.coalesce("_kind", F.lit("")) != "heading")).cast("int")
    numbered = scans.running_sum(before, group, seg, order, opens, "section_no")
    named = scans.running_last(numbered, group, seg, order, F.when(F.col("kind") == "heading", F.col("text")), "section")
    return named.drop("_kind", "_seg")


def clean_cut(left_kind: Column, left: Column, right_kind: Column, right: Column) -> Column:
    """A boundary between blocks that cuts no sentence: before a heading after a full sentence, after formula or table unless mid-sentence, else where right does not carry left on."""
    return (
        F.when(right_kind == "heading", (left_kind != "image") & T.ends_sentence(left))
        .when((left_kind == "image") | (right_kind == "formula"), False)
        .when(left_kind.isin("formula", "table"), ~T.starts_mid(right))
        .otherwise(~T.continues(left, right))
    )


def deletion_reason(text: Column, kind: Column, in_references: Column, dropped_section: Column, header: Column) -> Column:
    """First rule of the cascade that deletes a block; null: it stays."""
    return (
        F.when(in_references, "reference_list").when(dropped_section, "dropped_section").when((kind == "image") & text.rlike(r"^!\[\]"), "image_placeholder")
        .when(text.startswith("<small>"), "page_footnote").when(header, "running_header").when(text.rlike(T.PAGE_NUMBER), "page_number").when(text.rlike(r"(?i)^(doi|issn|udc|УДК)[ :]"), "metadata_block")
    )


def delete_cascade(blocks: DataFrame, group: str, order: list[str], headers: DataFrame, drop_sections: list[str], references: str = r"(?i)^(references|литература|literatur)$", segment: str | None = None) -> DataFrame:
    """Blocks with the rule that deletes each (rule null: kept). References last to the end of the group; a dropped section to the next heading. segment parts large groups."""
    rows, seg = (blocks, segment) if segment else (blocks.withColumn("_seg", F.lit(0)), "_seg")
    key = F.lower(F.trim("text"))
    heading = F.col("kind") == "heading"
    marked = scans.running_last(rows, group, seg, order, F.when(heading & F.trim("text").rlike(references), True), "refs")
    marked = scans.running_last(marked, group, seg, order, F.when(heading, key.isin([s.lower() for s in drop_sections])), "dropped")
    marked = marked.withColumn("refs", F.coalesce("refs", F.lit(False))).withColumn("dropped", F.coalesce("dropped", F.lit(False))).drop("_seg")
    heads = headers.select(group, F.col("line").alias("head_line")).distinct()
    joined = marked.join(heads, (marked[group] == heads[group]) & (F.trim(marked["text"]) == heads["head_line"]), "left").drop(heads[group])
    return joined.withColumn("rule", deletion_reason(F.col("text"), F.coalesce("kind", F.lit("")), F.col("refs"), F.col("dropped"), F.col("head_line").isNotNull())).drop("refs", "dropped", "head_line")


def merge_broken(blocks: DataFrame, group: str, order: list[str], hop: int = 5) -> DataFrame:
    """(group, paragraph, text, n_parts): body blocks joined where one carries the one before it on; captions stay out of the way and follow as paragraphs of their own. hop bounds how many captions may lie between two halves."""
    w = Window.partitionBy(group).orderBy(*order)
    caption = F.coalesce(F.col("kind"), F.lit("")).isin("image", "table") | F.col("text").rlike(T.CAPTION)
    flagged = blocks.withColumn("caption", caption).withColumn("at", F.row_number().over(w))
    body = Window.partitionBy(group, "caption").orderBy("at")
    before, gap = F.lag("text").over(body), F.col("at") - F.lag("at").over(body)
    joins = ~F.col("caption") & (F.coalesce(F.col("kind"), F.lit("paragraph")) == "paragraph") & F.coalesce(T.continues(before, F.col("text")) & (gap <= hop + 1), F.lit(False))
    marked = flagged.withColumn("fresh", (~joins).cast("int"))
    grouped = marked.withColumn("paragraph", F.sum("fresh").over(body.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy(group, "caption", "paragraph").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("p"))
    text = F.aggregate("p", F.lit(""), lambda a, x: F.when(a == "", x["text"]).when(a.rlike(r"\p{L}-$"), F.concat(F.regexp_replace(a, "-$", ""), x["text"])).otherwise(F.concat_ws(" ", a, x["text"])))
    out = parts.select(group, F.col("p")[0]["at"].alias("first_at"), text.alias("text"), F.size("p").alias("n_parts"))
    return out.withColumn("paragraph", F.row_number().over(Window.partitionBy(group).orderBy("first_at"))).drop("first_at")
