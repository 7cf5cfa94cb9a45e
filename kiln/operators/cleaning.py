"""Declarative rewrite rules with an audit, cleaning measures and multiset comparisons.

Defined results: null text stays null and is audited by no rule; a rule that changes nothing leaves no audit row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rewrite: pattern (Java syntax) and replacement ($1 for groups); literal: both are plain text."""

    name: str
    pattern: str
    replacement: str = ""
    literal: bool = False

    def apply(self, text: Column) -> Column:
        return F.replace(text, F.lit(self.pattern), F.lit(self.replacement)) if self.literal else F.regexp_replace(text, self.pattern, self.replacement)

    def matches(self, text: Column) -> Column:
        pattern = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", self.pattern) if self.literal else self.pattern
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: Rules of the cleaning pipeline, in their order.
CLEANING = [
    Rule("control", r"[\x00-\x08\x0B-\x1F​-‍⁠﻿]", ""),
    Rule("citations", r" ?\[[0-9]+(?:, ?[0-9]+)*\]", ""),
    Rule("superscripts", r"\$\^\{?[0-9, ]+\}?\$", ""),
    Rule("journal_tail", r"(?m) ?(?:UDC|УДК|DOI) [0-9./-]+$", ""),
    Rule("tags", r"</?(?:b|i|em|strong|span|p|sup|sub|u|font)(?: [^<>]*)?>", ""),
    Rule("escapes", r"\\([_*#&%])", "$1"),
    Rule("hyphens", r"(\p{Ll})[-¬]\n\s*(\p{Ll})", "$1$2"),
    Rule("leader_dots", r"\.{4,}", " "),
    Rule("spaced_digits", r"(?<=[0-9]) (?=[0-9]{3}(?:[^0-9]|$))", ""),
    Rule("space_before_punctuation", r" +([,.;:!?])", "$1"),
    Rule("whitespace", r"[ \t]{2,}", " "),
]


def clean(texts: DataFrame, key: str, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """texts with column clean after all rules in order."""
    out = F.col(text)
    for rule in rules or CLEANING:
        out = rule.apply(out)
    return texts.withColumn("clean", out)


def _fired(name: str, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(name).alias("rule"), m.alias("before")))


def audit(texts: DataFrame, key: str, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(key, rule, before, n): what each rule met in the text as the rules before it left it; one row a distinct match."""
    out, steps = F.col(text), []
    for rule in rules or CLEANING:
        steps.append(_fired(rule.name, rule.matches(out)))
        out = rule.apply(out)
    fired = texts.filter(F.col(text).isNotNull()).select(key, F.explode(F.concat(*steps)).alias("a"))
    return fired.groupBy(key, "a.rule", "a.before").agg(F.count("*").alias("n"))


def outside_math(texts: DataFrame, key: str, rewrite: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """texts with column rewritten: the parts between formulas go through rewrite, formulas stay."""
    math = r"\$\$[^$]*\$\$|\$[^$\n]+\$|\\\[[^\]]*\\\]"
    plain, held = F.split(F.col(text), math, -1), F.regexp_extract_all(text, F.lit(math), F.lit(0))
    return texts.withColumn("rewritten", F.array_join(F.zip_with(F.transform(plain, rewrite), F.concat(held, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def normal_form(texts: DataFrame, key: str, text: str = "text", form: str = "NFC") -> DataFrame:
    """(key, text in a Unicode normal form); there is no built-in, so batches go through Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], text: pd.Series([None if t is None else unicodedata.normalize(form, t) for t in b[text]], dtype=object)})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, {text} string")


def vocabulary(texts: DataFrame, group: str, text: str = "text", pattern: str = r"\p{L}+(?:-\p{L}+)*") -> DataFrame:
    """(group, word, n): lower-case words of each group; hyphenated words are one word."""
    words = texts.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy(group, "word").agg(F.count("*").alias("n"))


def compounds(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, word, n): words hyphenated within a line."""
    return vocabulary(texts, group, text).filter(F.col("word").contains("-"))


def join_breaks(texts: DataFrame, key: str, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(key, left, right, decision): each word broken over a line end: keep_tail before a conjunction, hyphen where the compound is known, join where the joined word is, else join for Cyrillic, keep for the rest. lexicon: (word)."""
    broken = r"(\p{L}+)[-¬]\n\s*(\p{L}+)"
    pairs = texts.select(key, F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(broken), F.lit(1)).alias("l"), F.regexp_extract_all(text, F.lit(broken), F.lit(2)).alias("r"))).alias("p")).select(key, F.col("p.l").alias("left"), F.col("p.r").alias("right"))
    words = lexicon.select("word").distinct()
    a = pairs.withColumn("one", F.lower(F.concat("left", "right"))).withColumn("two", F.lower(F.concat_ws("-", "left", "right")))
    a = a.join(words.select(F.col("word").alias("one"), F.lit(True).alias("k1")), "one", "left").join(words.select(F.col("word").alias("two"), F.lit(True).alias("k2")), "two", "left")
    decision = F.when(F.lower("right").isin("and", "or", "und", "oder", "и", "или", "а"), "keep_tail").when(F.col("k2"), "hyphen").when(F.col("k1"), "join").when(F.col("right").rlike(r"^[а-яё]"), "join").otherwise("keep")
    return a.select(key, "left", "right", decision.alias("decision"))


def text_measures(text: Column) -> list[Column]:
    """Lengths and counts of one text: characters, numbers, formulas, table cells, marks, personal data."""
    n = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return [
        F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), n(r"[0-9]+(?:[.,][0-9]+)?").alias("n_numbers"), n(r"\$[^$\n]+\$").alias("n_formulas"), n(r"<td>").alias("n_cells"), n(r"\[[0-9]+(?:, ?[0-9]+)*\]").alias("n_citations"),
        n(r"</?[a-z]+>").alias("n_tags"), n(r"\p{Ll}[-¬]\n").alias("n_breaks"), n(r"[\p{L}0-9._-]+@[\p{L}0-9-]+\.[a-z]+").alias("n_emails"), n(r"\+?[0-9]{1,3}[ (-]+[0-9]{3}[ )-]+[0-9]{3}[- ]?[0-9]{2}").alias("n_phones"), n(r"\p{Lu}\. ?\p{Lu}\. \p{Lu}\p{Ll}+").alias("n_names"),
    ]


def noise_characters(texts: DataFrame, key: str, patterns: list[str], text: str = "text") -> DataFrame:
    """(key, n_chars, n_noise): characters under any of the patterns, overlaps counted once. A text is marked once for all patterns, so no span leaves its row."""
    masks = [re.compile(p, re.M) for p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                spans = sorted(m.span() for p in masks for m in p.finditer(t or ""))
                total, end = 0, 0
                for x, y in spans:
                    total, end = total + max(0, y - max(x, end)), max(end, y)
                out.append((k, len(t or ""), total))
            yield pd.DataFrame(out, columns=[key, "n_chars", "n_noise"])

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, n_chars int, n_noise int")


def numbers(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number): every number in canonical form (point for comma, no groups)."""
    raw = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))).alias("number"))
    return raw.select(key, F.regexp_replace("number", ",", ".").alias("number"))


def formulas(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, formula): every formula between dollar signs, without blanks."""
    raw = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\$[^$\n]+\$"), F.lit(0))).alias("formula"))
    return raw.select(key, F.replace("formula", F.lit(" "), F.lit("")).alias("formula"))


def cells(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, cell): every cell of an HTML table that is not empty, in lower case."""
    raw = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"<td>([^<]*)</td>"), F.lit(1))).alias("cell"))
    return raw.select(key, F.lower(F.trim("cell")).alias("cell")).filter("cell <> ''")


def kept_and_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of before with how often each stands (n_before), is kept (n_kept) and is lost (n_lost) in after, as multisets: one count a side and one join, however often a row stands."""
    cols = before.columns
    a, b = before.groupBy(*cols).agg(F.count("*").alias("n_before")), after.groupBy(*cols).agg(F.count("*").alias("n_after"))
    kept = F.least("n_before", F.coalesce("n_after", F.lit(0)))
    return a.join(b, cols, "left").select(*cols, "n_before", kept.alias("n_kept"), (F.col("n_before") - kept).alias("n_lost"))


def changed_words(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, changed): words that a sequence alignment replaces, deletes or inserts; of a replaced stretch the longer side counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            out = []
            for k, x, y in zip(b[key], b[before], b[after]):
                ops = SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).get_opcodes()
                out.append((k, sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in ops if op != "equal")))
            yield pd.DataFrame(out, columns=[key, "changed"])

    return pairs.select(key, before, after).mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, changed int")
