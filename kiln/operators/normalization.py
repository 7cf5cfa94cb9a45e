"""Normalisation of cleaned text: rule pipeline, masks, periodic annotation, term and lemma work over lexicon tables.

Morphology and part-of-speech models are not at hand: lemmas come from lexicon tables (word, lemma) built from the corpus, and say so.
Defined results: null text stays null; a rule without a match changes nothing; a mask that is not found again stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.operators.cleaning import Rule

# Greek macros and their letters.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "varepsilon": "ε", "epsilon": "ε", "lambda": "λ", "mu": "μ", "sigma": "σ", "tau": "τ", "omega": "ω", "Delta": "Δ"}

TEMPERATURE = [
    Rule("temperature_words", r"([0-9]) ?(?:degrees? (?:Celsius|centigrade|C)|deg\.? C|Grad Celsius|градусов Цельсия|град\.?)(?![\p{L}/])", "$1 °C"),
    Rule("temperature_sign", r"([0-9]) ?° ?[CС](?![\p{L}/])", "$1 °C"),
    Rule("temperature_range", r"([0-9]+)°? ?(?:–|—|-|to|до|bis) ?([0-9]+ °C)", "$1–$2"),
]
UNITS = [
    Rule("newton", r"(?:N/mm2|Н/мм2|Н/мм²|МПа|MPa)(?!\p{L})", "N/mm²"),
    Rule("kgf", r"(?:kgf/mm2|kg/mm2|кгс/мм2|кГ/мм2|кгс/мм²)", "kgf/mm²"),
    Rule("micron", r"(?:мкм|microns?|µm)(?!\p{L})", "μm"),
    Rule("millimetre", r"(?:мм|millimetres?)(?![\p{L}2²])", "mm"),
    Rule("gigapascal", r"(?<=[0-9] )ГПа(?!\p{L})", "GPa"),
    Rule("pascal", r"(?<=[0-9] )Па(?!\p{L})", "Pa"),
    Rule("kilonewton", r"(?<=[0-9] )кН(?!\p{L})", "kN"),
    Rule("meganewton", r"(?<=[0-9] )МН(?![\p{L}/])", "MN"),
    Rule("tonne_force", r"(?<=[0-9] )тс(?!\p{L})", "tf"),
    Rule("kilojoule", r"(?<=[0-9] )кДж(?!\p{L})", "kJ"),
    Rule("joule", r"(?<=[0-9] )Дж(?![\p{L}/])", "J"),
    Rule("nanometre", r"(?<=[0-9] )нм(?![\p{L}2²])", "nm"),
    Rule("centimetre", r"(?<=[0-9] )см(?![\p{L}2²])", "cm"),
    Rule("per_second", r"(?<=°C|K) ?/ ?(?:с|сек|sec)(?![\p{L}])", "/s"),
    Rule("per_minute", r"(?<=°C|K) ?/ ?(?:мин|Min)(?![\p{L}])", "/min"),
    Rule("mass_percent", r"(?:wt\.? ?%|мас\. ?%|масс\. ?%|Gew\.-%|Masse-%)", "wt.%"),
]
#: Critical points of steel, in either alphabet, with or without marks: Ac3, Ar1.
CRITICAL = Rule("critical_point", r"(?<![\p{L}])\$?[AА]_?\{?([crсг])_?\{?([1-4])\}*\$?(?![\p{L}0-9])", "A$1$2")
#: Degrees in the header of a column.
HEADER_UNIT = Rule("header_unit", r"([,(\[] ?)(?:°\s?[CС]|град\.?|deg\.? ?C?)(?=[)\]]?\s*(?:\||</t[hd]>|&))", "$1°C")
COMPOSITION = Rule("composition", r"(?<=\p{Lu}\p{Ll}?)[—-](?=\p{Lu}\p{Ll}?(?:[—-]|[^\p{L}0-9-]|$))", "–")


def greek_rules() -> list[Rule]:
    """One rule a macro, the longest first, so that no macro eats the head of another."""
    return [Rule(f"greek_{k}", rf"\\{k}(?![a-zA-Z])", v) for k, v in sorted(GREEK.items(), key=lambda kv: -len(kv[0]))]


def normalize(text: Column, rules: list[Rule] | None = None) -> Column:
    """All rules in order: temperatures, Greek, units, composition dashes."""
    for rule in rules or [*TEMPERATURE, *greek_rules(), *UNITS, COMPOSITION]:
        text = rule.apply(text)
    return text


def mask(text: Column, pattern: str = r"\$\$[^$]*\$\$|\$[^$\n]+\$|<table[\s\S]*?</table>") -> tuple[Column, Column]:
    """(text with private-use marks for protected spans, the spans); unmask() is its inverse."""
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    marked = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\ue000"), i.cast("string"), F.lit("\ue001"), p))), "")
    return marked, spans


def unmask(text: Column, spans: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1))), text, lambda a, i: F.when(i <= F.size(spans), F.replace(a, F.concat(F.lit("\ue000"), i.cast("string"), F.lit("\ue001")), F.get(spans, i - 1))).otherwise(a))


def annotate(texts: DataFrame, key: str, terms: dict[str, str], text: str = "text", distance: int = 3000) -> DataFrame:
    """(key, text, n): each term replaced by 'canonical (term)', but not within distance characters of its last replacement in the text and not where the canonical form stands beside it already. Sequential, so by Arrow batches."""
    found = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?!\w)", re.I) if terms else None
    low = {k.lower(): v for k, v in terms.items()}

    def one(t: str | None) -> tuple[str | None, int]:
        if not t or found is None:
            return t, 0
        last: dict[str, int] = {}
        out, at, n = [], 0, 0
        for m in found.finditer(t):
            k = m[0].lower()
            if (k in last and m.start() - last[k] < distance) or t[max(0, m.start() - len(low[k]) - 2) : m.start()].lower().endswith(low[k].lower() + " ("):
                continue
            out += [t[at : m.start()], f"{low[k]} ({m[0]})"]
            at, n, last[k] = m.end(), n + 1, m.start()
        return "".join([*out, t[at:]]), n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = [one(t) for t in b[text]]
            yield pd.DataFrame({key: b[key], text: pd.Series([x[0] for x in r], dtype=object), "n": [x[1] for x in r]})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, {text} string, n int")


def expand(text: Column, abbreviations: dict[str, str]) -> Column:
    """Abbreviations written out, the longest first."""
    for short, long in sorted(abbreviations.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}]){re.escape(short)}(?![\p{{L}}\p{{N}}])", long)
    return text


def terms(texts: DataFrame, text: str = "text", least: int = 3, shortest: int = 4, stop: DataFrame | None = None) -> DataFrame:
    """(term, n): words of shortest letters or more that stand least times or more, without the stop words (column word)."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("term")).filter(F.length("term") >= shortest)
    out = words.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return out.join(stop.select(F.col("word").alias("term")), "term", "left_anti") if stop is not None else out


def plurals(words: DataFrame) -> DataFrame:
    """(word, lemma): regular English plurals whose singular is in words (column word) too; the longest fitting singular counts."""
    base = words.select("word").distinct()
    cut = F.when(F.col("word").rlike("ies$"), F.array(F.regexp_replace("word", "ies$", "y"))).when(F.col("word").rlike("(s|x|z|ch|sh)es$"), F.array(F.regexp_replace("word", "es$", ""), F.regexp_replace("word", "s$", ""))).when(F.col("word").rlike("[^s]s$"), F.array(F.regexp_replace("word", "s$", ""))).otherwise(F.array().cast("array<string>"))
    tried = base.select("word", F.explode(cut).alias("lemma")).join(base.select(F.col("word").alias("lemma")), "lemma")
    return tried.groupBy("word").agg(F.max_by("lemma", F.struct(F.length("lemma"), "lemma")).alias("lemma"))


def like_case(model: Column, word: Column) -> Column:
    """word in the case of model: upper, capitalised or as it is."""
    return F.when((model == F.upper(model)) & (F.length(model) > 1), F.upper(word)).when(F.substring(model, 1, 1) == F.upper(F.substring(model, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.expr("substring(" + "lemma" + ", 2)"))).otherwise(word)


def lemmatize(texts: DataFrame, key: str, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(key, word, lemma, n): words of each text with their lemma from a lexicon (word, lemma), in the case of the text."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}+"), F.lit(0))).alias("form")).groupBy(key, "form").agg(F.count("*").alias("n"))
    hit = words.withColumn("word", F.lower("form")).join(lexicon.select("word", "lemma"), "word")
    return hit.select(key, F.col("form").alias("word"), like_case(F.col("form"), F.col("lemma")).alias("lemma"), "n")


def relemmatize(texts: DataFrame, key: str, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) with each word of the lexicon (word, lemma) replaced by its lemma in the case of the text. Words meet the lexicon by a join; a text is put together from its pieces by place, whatever its words."""
    pieces = texts.select(key, text).withColumn("_p", F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)))
    words = pieces.select(key, F.explode(F.array_distinct(F.filter("_p", lambda x: x.rlike(r"^\p{L}")))).alias("form")).distinct().withColumn("word", F.lower("form"))
    hit = words.join(lexicon.select("word", "lemma").dropDuplicates(["word"]), "word").select(key, "form", like_case(F.col("form"), F.col("lemma")).alias("to"))
    by = hit.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("form", "to"))).alias("_m"))
    done = F.array_join(F.transform("_p", lambda x: F.coalesce(F.try_element_at("_m", x), x)), "")
    return pieces.join(by, key, "left").select(key, F.when(F.col("_m").isNull(), F.col(text)).otherwise(done).alias(text))


def unit_share(text: Column) -> list[Column]:
    """Values with a temperature or stress unit, and how many are in canonical form."""
    any_ = r"[0-9] ?(?:°|deg|Grad|град|K(?![\p{L}])|MPa|МПа|N/mm|Н/мм|kgf/mm|кгс/мм)"
    good = r"[0-9] (?:°C|N/mm²|kgf/mm²)"
    return [F.regexp_count(text, F.lit(any_)).alias("n_units"), F.regexp_count(text, F.lit(good)).alias("n_canonical")]


def value_checks(text: Column, last_year: int = 2100) -> list[Column]:
    """Temperatures and how many lie in -273..1600 °C; numbers of four digits that stand alone between 1000 and 2999, and how many are years of 1800..last_year."""
    degrees = F.transform(F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:[.,][0-9]+)?) ?°C"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9.,])([12][0-9]{3})(?:[^0-9.,]|$)"), F.lit(1)), lambda x: x.cast("int"))
    return [
        F.size(degrees).alias("n_temperatures"), F.size(F.filter(degrees, lambda x: (x >= -273) & (x <= 1600))).alias("n_sound_temperatures"),
        F.size(years).alias("n_years"), F.size(F.filter(years, lambda x: (x >= 1800) & (x <= last_year))).alias("n_sound_years"),
    ]


def in_every_group(texts: DataFrame, group: str, words: DataFrame, text: str = "text") -> DataFrame:
    """(word): words (column word, lower case) that stand in the texts of every group: relational division."""
    groups = texts.select(group).distinct().count()
    seen = texts.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct().join(words.select("word").distinct(), "word", "left_semi")
    return seen.groupBy("word").agg(F.count("*").alias("k")).filter(F.col("k") == groups).select("word")
