"""Chunks: token windows, structural packing, overlap, measures of boundaries.

Defined results: empty texts give no chunk; a block above the hard limit is cut at sentence ends, and between words only where a sentence is above the limit itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions import text as T
from kiln.operators import scans

#: Characters of a text that are packed in one task.
STRETCH = 400_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[A-ZА-ЯЁÄÖÜ(«\"])")


def token_windows(texts: DataFrame, key: str, text: str = "text", size: int = 1200, overlap: int = 100) -> DataFrame:
    """(key, window, first_token, n_tokens, tokens): windows of size tokens that share overlap; the last ends with the text."""
    step = size - overlap
    t = texts.select(key, T.tokens(F.col(text)).alias("t")).filter("size(t) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - overlap) / F.lit(step)).cast("int") - 1)
    w = t.select(key, "t", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return w.select(key, "window", (F.col("window") * step).alias("first_token"), F.slice("t", F.col("window") * step + 1, size).alias("tokens")).select(key, "window", "first_token", F.size("tokens").alias("n_tokens"), "tokens")


def word_windows(texts: DataFrame, key: str, text: str = "text", size: int = 300) -> DataFrame:
    """(key, window, n_words, words): words in windows that do not overlap; the short last one is kept."""
    t = texts.select(key, F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)).alias("t")).filter("size(t) > 0")
    w = t.select(key, "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / size).cast("int"))).alias("window"))
    return w.select(key, "window", F.slice("t", F.col("window") * size + 1, size).alias("words")).select(key, "window", F.size("words").alias("n_words"), "words")


def pack(blocks: list[tuple[str, str, int, int]], target: int, least: int, hard: int) -> list[tuple[str | None, int, int, int]]:
    """(section, start, end, tokens) of the chunks of one text. blocks: (kind, text, start, end) in order. Sections are merged forward while small, filled to target, cut at the best clean place, a short tail joins up to hard."""
    count = lambda t: len(_TOKEN.findall(t))
    pieces: list[tuple[str, str, int, int, int]] = []
    for kind, text, start, end in blocks:
        n = count(text)
        if n <= hard or kind != "paragraph":
            pieces.append((kind, text, start, end, n))
            continue
        at, cut = start, start
        for s in _SENTENCE.split(text):
            i = text.find(s, cut - start)
            if count(text[at - start : i + len(s)]) > target and start + i > at:
                pieces.append((kind, text[at - start : i].rstrip(), at, start + len(text[: i].rstrip()), count(text[at - start : i])))
                at = start + i
            cut = start + i + len(s)
        pieces.append((kind, text[at - start :], at, end, count(text[at - start :])))
    sections: list[list[tuple[str, str, int, int, int]]] = []
    for p in pieces:
        if p[0] == "heading" and sections and any(x[0] != "heading" for x in sections[-1]) or not sections:
            sections.append([])
        sections[-1].append(p)
    merged: list[list] = []
    for s in sections:
        if merged and sum(x[4] for x in merged[-1]) < least and sum(x[4] for x in merged[-1] + s) <= target:
            merged[-1] += s
        else:
            merged.append(list(s))
    out: list[list] = []
    for s in merged:
        group: list = []
        for p in s:
            if group and sum(x[4] for x in group) + p[4] > target:
                out.append(group)
                group = []
            group.append(p)
        if group and out and sum(x[4] for x in group) < least and sum(x[4] for x in out[-1]) + sum(x[4] for x in group) <= hard:
            out[-1] += group
        elif group:
            out.append(group)
    return [(next((x[1] for x in g if x[0] == "heading"), None), g[0][2], g[-1][3], sum(x[4] for x in g)) for g in out]


def structural_chunks(blocks: DataFrame, group: str, target: int = 900, least: int = 250, hard: int = 1100) -> DataFrame:
    """(group, stretch, chunk_no, section, start_pos, end_pos, n_tokens): blocks (kind, text, start_pos, end_pos) of each text packed in order. A task holds a stretch of STRETCH characters of a text, so that no text is one task's alone; chunks end with their stretch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stretch = int(pdf.stretch.iloc[0])
        pdf = pdf.sort_values("start_pos", kind="stable")
        rows = pack([(k or "paragraph", t or "", int(a), int(b)) for k, t, a, b in zip(pdf.kind, pdf.text, pdf.start_pos, pdf.end_pos)], target, least, hard)
        return pd.DataFrame([(pdf[group].iloc[0], stretch, i, *r) for i, r in enumerate(rows)], columns=[group, "stretch", "chunk_no", "section", "start_pos", "end_pos", "n_tokens"])

    kind = dict(blocks.dtypes)[group]
    return blocks.select(group, "kind", "text", "start_pos", "end_pos", F.floor(F.col("start_pos") / STRETCH).alias("stretch")).groupBy(group, "stretch").applyInPandas(run, f"{group} {kind}, stretch long, chunk_no int, section string, start_pos int, end_pos int, n_tokens int")


def overlapped(chunks: DataFrame, group: str, order: list[str], text: str = "text", share: float = 0.075, limit: int = 1100, segment: str | None = None) -> DataFrame:
    """chunks with column extended: whole sentences of the neighbours, up to share of the chunk's tokens on each side and limit in all."""
    rows, seg = (chunks, segment) if segment else (chunks.withColumn("_seg", F.lit(0)), "_seg")
    rows = scans.neighbour(rows, group, seg, order, {"left_text": F.col(text)}, ahead=False)
    rows = scans.neighbour(rows, group, seg, order, {"right_text": F.col(text)}).drop("_seg")
    count = lambda t: len(_TOKEN.findall(t))

    def side(t: str | None, budget: int, from_end: bool) -> str:
        got, used = [], 0
        sentences = _SENTENCE.split(t or "")
        for s in reversed(sentences) if from_end else sentences:
            n = count(s)
            if not s.strip() or used + n > budget:
                break
            got.append(s.strip())
            used += n
        return " ".join(reversed(got) if from_end else got)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, x, y in zip(b[text], b.left_text, b.right_text):
                n = count(t or "")
                budget = min(int(n * share), max(0, (limit - n) // 2))
                out.append("\n\n".join(p for p in (side(x, budget, True), t or "", side(y, budget, False)) if p))
            yield b.assign(extended=out)

    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes) + ", extended string"
    return rows.mapInPandas(run, schema).drop("left_text", "right_text")


def cut_spans(spans: DataFrame, cuts: DataFrame, group: str, width: int = 2000) -> DataFrame:
    """Spans (group, start_pos, end_pos) that a cut (group, pos) lies within: start < pos < end. A range join by buckets of width; a span meets only cuts of its own buckets.

    Cuts are often exploded from a row a group, and Spark's estimate knows nothing of that: without the hint it would broadcast all of them as if they were those few rows."""
    s = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor(F.col("end_pos") / width))))
    c = cuts.select(group, "pos").distinct().withColumn("bucket", F.floor(F.col("pos") / width))
    return s.join(c.hint("merge"), [group, "bucket"]).filter("start_pos < pos and pos < end_pos").drop("bucket")


def not_whole(spans: DataFrame, chunks: DataFrame, group: str, key: str, width: int = 2000) -> DataFrame:
    """Spans that lie whole in no chunk (group, start_pos, end_pos): left anti range join by the bucket of the span's start. For the hints see cut_spans."""
    s = spans.withColumn("bucket", F.floor(F.col("start_pos") / width))
    c = chunks.select(group, F.col("start_pos").alias("c_start"), F.col("end_pos").alias("c_end")).distinct().withColumn("bucket", F.explode(F.sequence(F.floor(F.col("c_start") / width), F.floor(F.greatest(F.col("c_end") - 1, "c_start") / width))))
    within = s.join(c.hint("merge"), [group, "bucket"]).filter("c_start <= start_pos and end_pos <= c_end").select(key).distinct()
    return spans.join(within.hint("merge"), key, "left_anti")
