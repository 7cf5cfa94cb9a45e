"""Quality of graph vertices: noise labels, formula names, integrity, lexical duplicates.

Defined results: a null name has no label; lemma keys come from plural folding and case, no morphology model being at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that stand for something named elsewhere.
PRONOUNS = ["IT", "THIS", "THEY", "ОН", "ОНА", "ОНО", "ЭТО", "ES", "SIE", "ER"]


def is_formula(name: Column) -> Column:
    return name.rlike(r"[\\=^_{}]|^[\p{Lu}\p{Ll}]_?[0-9]*$|^\p{Lu}\p{Ll}?[0-9]+(?:\p{Lu}\p{Ll}?[0-9]*)*$")


def noise_labels(name: Column) -> Column:
    """Array of the rules that call a name noise."""
    return F.array_compact(
        F.array(
            F.when(name.rlike(r"^[\p{P}\p{S}\s]+$"), "punctuation"), F.when(name.rlike(r"\\[a-zA-Z]+"), "latex"), F.when(name.rlike(r"^[0-9.,]+( ?(?:°C|K|MPa|mm|%))?$"), "number"),
            F.when(F.upper(name).isin(PRONOUNS), "pronoun"), F.when(name.rlike(r"^\p{L}{1,2}$|-$"), "broken"), F.when(name.rlike(r"^\p{Lu}{2}-[0-9]+$"), "code"),
        )
    )


def cross_script(a: Column, b: Column) -> Column:
    """One name Cyrillic, the other not."""
    return a.rlike(r"\p{IsCyrillic}") != b.rlike(r"\p{IsCyrillic}")


def lemma_key(name: Column) -> Column:
    """Lower-case words of four letters or more without a plural s, in order."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) >= 4) & w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)), " ")


def duplicate_names(names: DataFrame) -> DataFrame:
    """(lemma_key, n, names): different names of one key."""
    return names.select("name").distinct().withColumn("lemma_key", lemma_key(F.col("name"))).groupBy("lemma_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names")).filter("n > 1 and lemma_key <> ''")


def integrity(items: DataFrame, windows: DataFrame) -> DataFrame:
    """(item_id, n_atoms, best): largest share of an item's atoms (item_id, atoms array) within one window (window_id, atoms array); items of fewer than two atoms are left out. Atoms meet by equality, no item is held against every window."""
    i = items.filter(F.size(F.array_distinct("atoms")) >= 2).select("item_id", F.size(F.array_distinct("atoms")).alias("n_atoms"), F.explode(F.array_distinct("atoms")).alias("atom"))
    w = windows.select("window_id", F.explode(F.array_distinct("atoms")).alias("atom"))
    met = i.join(w, "atom").groupBy("item_id", "n_atoms", "window_id").agg(F.count("*").alias("k"))
    best = met.groupBy("item_id").agg(F.max("k").alias("k"))
    return i.select("item_id", "n_atoms").distinct().join(best, "item_id", "left").select("item_id", "n_atoms", (F.coalesce("k", F.lit(0)) / F.col("n_atoms")).alias("best"))


def contained_terms(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, covered): whether the key of a term stands as whole words within the key of a name. By word n-grams of the names, up to the longest term."""
    t = terms.select("term").distinct().withColumn("k", lemma_key(F.col("term")))
    longest = t.agg(F.max(F.size(F.split("k", " ")))).first()[0] or 1
    words = names.select(F.split(lemma_key(F.col("name")), " ").alias("w")).distinct()
    grams = words.select(F.explode(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), _gram(n)) for n in range(1, longest + 1)]))).alias("k")).distinct()
    return t.join(grams.withColumn("hit", F.lit(True)), "k", "left").select("term", F.coalesce("hit", F.lit(False)).alias("covered"))


def _gram(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def ngram_terms(texts: DataFrame, key: str, text: str = "text", stop: tuple[str, ...] = (), sizes: tuple[int, ...] = (2, 3), least: int = 3) -> DataFrame:
    """(gram, n): runs of words between stop words and punctuation, cut into grams, that stand least times or more."""
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+(?: \p{L}+)*"), F.lit(0))
    pieces = F.flatten(F.transform(runs, lambda r: F.split(F.concat(F.lit(" "), F.replace(r, F.lit(" "), F.lit("  ")), F.lit(" ")), " (?:" + "|".join(stop or ("\u0000",)) + ") ")))
    w = texts.select(F.explode(pieces).alias("p")).select(F.regexp_extract_all("p", F.lit(r"\p{L}+"), F.lit(0)).alias("w")).filter(F.size("w") >= min(sizes))
    grams = w.select(F.explode(F.flatten(F.array(*[F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), _gram(n))).otherwise(F.array().cast("array<string>")) for n in sizes]))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
