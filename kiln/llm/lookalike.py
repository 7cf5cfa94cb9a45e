"""Text brought to one consistent form: full-width and other compatibility forms, combining marks, invisible characters, unusual blanks, look-alike letters.

A text is cut into runs of letters and runs of other characters. Runs that hold a character of the mapping table, or letters of
two scripts, are exploded to positioned code points and joined with the broadcast decomposition and look-alike tables (built by
rule from the Unicode database; bounded by Unicode itself). Marks are ordered by combining class within their cluster, composed
again, and the run is put back at its place. All other runs stay as they are.

Defined results: null text stays null and is no case; empty text is unchanged; repeated rows count once; texts of any length are cut into runs first, so no
task holds more than a run's code points beside its row. Superscripts, dashes, Greek in formulas, unit symbols and foreign words keep their form.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of letters of the same look.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅӀ", "aeopcyxijshdqwABEKMHOPCTYXIJSI"))
LATIN_CYRILLIC = dict(zip("aeopcyxkABEKMHOPCTYX", "аеорсухкАВЕКМНОРСТУХ"))
GREEK_LATIN = dict(zip("οΟΑΒΕΖΗΙΚΜΝΡΤΥΧνρι", "oOABEZHIKMNPTYXvpi"))
GREEK_CYRILLIC = dict(zip("οΟΑΒΕΗΚΜΡΤΥΧρ", "оОАВЕНКМРТУХр"))
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Forms that look different from what they decompose to, or that belong to units and notation.
KEPT = {"µ", "…", "´", "¨", "¯", "¸", "№", "℃", "℉", "™", "Å", "Ω"}

RUNS = r"[\p{L}\p{M}\p{Cf}]+|[^\p{L}\p{M}\p{Cf}]+"
LETTERS = r"^[\p{L}\p{M}\p{Cf}]"
_LAT, _CYR = r"\p{IsLatin}", r"\p{IsCyrillic}"
#: JVM test for a text that may change: a mapped character, or letters of two scripts side by side.
_SPECIAL = r"[ ª­ºĲ-ĳĿ-ŀŉſǄ-ǌǱ-ǳ̀-ͯ؜ ᠎ -‏‪-  -⁯℀-⅏Ⅰ-ↈ①-⓿⼀-⿟　ㄱ-㏿豈-﫿ﬀ-ﬆﬓ-﷿︀-﹏ﹰ-﻿！-￮]|[\x{1D400}-\x{1D7FF}]"
_MIXED = rf"{_LAT}[\p{{M}}\p{{Cf}}]*[{_CYR}\p{{IsGreek}}]|[{_CYR}\p{{IsGreek}}][\p{{M}}\p{{Cf}}]*{_LAT}|{_CYR}[\p{{M}}\p{{Cf}}]*\p{{IsGreek}}|\p{{IsGreek}}[\p{{M}}\p{{Cf}}]*{_CYR}"


def mapping(spark: SparkSession) -> DataFrame:
    """(ch, parts, variant): what each code point that has another form decomposes to; variant tells whether the character itself makes a case. By rule over the Unicode database, below 20 000 rows."""
    rows = [(chr(c), [], True) for c in INVISIBLE] + [(chr(c), [" "], True) for c in SPACES]
    done = {r[0] for r in rows}
    for c in range(0x80, 0x1F000):
        ch = chr(c)
        if ch in done or ch in KEPT or 0xAC00 <= c < 0xD7B0 or 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.decomposition(ch)
        if not kind or kind.startswith(("<super>", "<sub>", "<fraction>")):
            continue
        parts = list(unicodedata.normalize("NFKD", ch))
        rows.append((ch, parts, unicodedata.normalize("NFC", ch) != unicodedata.normalize("NFKC", ch) or unicodedata.normalize("NFC", ch) != ch))
    return spark.createDataFrame(rows, "ch string, parts array<string>, variant boolean")


def marks(spark: SparkSession) -> DataFrame:
    """(part, ccc) of the combining marks."""
    return spark.createDataFrame([(chr(c), unicodedata.combining(chr(c))) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))], "part string, ccc int")


def _composed() -> Column:
    """Literal map base+mark -> composed letter, of the Latin, Greek and Cyrillic blocks."""
    pairs = {}
    for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(c):
            pairs[unicodedata.normalize("NFC", d[:-1]) + d[-1]] = chr(c)
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _pairs(d: dict[str, str]) -> tuple[str, str]:
    return "".join(d), "".join(d.values())


def _count(run: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(run, f"[^{cls}]", ""))


def _fixes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with rid, a digest of the row; rid, variant and the fixed runs by place of each text that changes). Only touched runs are shuffled, no whole text."""
    spark = texts.sparkSession
    rows = texts.select("record_kind", "record_key", "text").withColumn("rid", F.md5(F.concat_ws("\u0001", "record_kind", F.coalesce("record_key", F.lit("\u0000")), "text")))
    touched = F.col("text").rlike(f"{_SPECIAL}|{_MIXED}") | F.col("text").rlike(rf"(?<={_LAT} ){_CYR}+(?= {_LAT})|(?<={_CYR} ){_LAT}+(?= {_CYR})")
    work = rows.filter(touched).withColumn("runs", F.regexp_extract_all("text", F.lit(f"({RUNS})"), 0))
    runs = work.select("rid", F.posexplode("runs").alias("at", "run"), "runs").withColumn("before", F.get("runs", F.col("at") - 2)).withColumn("after", F.get("runs", F.col("at") + 2))
    runs = runs.withColumn("gaps", (F.get("runs", F.col("at") - 1) == " ") & (F.get("runs", F.col("at") + 1) == " ")).drop("runs")
    #: A word wholly in the other script's look-alikes between two words of the text's script.
    lat_all, cyr_all = "^[" + "".join(LATIN_CYRILLIC) + "]+$", "^[" + "".join(CYRILLIC_LATIN) + "]+$"
    lower = F.col("run").rlike(r"^\p{Lu}?\p{Ll}+$")
    stray_cyr = F.col("gaps") & lower & F.col("run").rlike(cyr_all) & F.col("before").rlike(rf"^{_LAT}{{2,}}$") & F.col("after").rlike(rf"^{_LAT}{{2,}}$")
    stray_lat = F.col("gaps") & lower & F.col("run").rlike(lat_all) & F.col("before").rlike(rf"^{_CYR}+$") & F.col("after").rlike(rf"^{_CYR}{{2,}}$")
    runs = runs.withColumn("stray", F.coalesce(F.when(stray_cyr, "latin").when(stray_lat, "cyrillic"), F.lit("")))
    odd = runs.filter(F.col("run").rlike(f"{_SPECIAL}|{_MIXED}") | (F.col("stray") != "")).select("rid", "at", "run", "stray").distinct()

    points = odd.select("rid", "at", "stray", F.posexplode(F.regexp_extract_all("run", F.lit("((?s).)"), 0)).alias("pos", "ch"))
    parts = points.join(F.broadcast(mapping(spark)), "ch", "left").select("rid", "at", "stray", "pos", F.coalesce("variant", F.lit(False)).alias("variant"), F.posexplode_outer(F.coalesce("parts", F.array("ch"))).alias("sub", "part"))
    parts = parts.join(F.broadcast(marks(spark)), "part", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    # Within a run: clusters of a starter and its marks, marks ordered by class, then composed again.
    listed = parts.groupBy("rid", "at", "stray").agg(F.max("variant").alias("variant"), F.sort_array(F.collect_list(F.struct("pos", "sub", "part", "ccc"))).alias("ps"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<ccc:int,n:int,part:string>>").alias("open"), F.lit("").alias("base"), F.lit(False).alias("lone"))
    composed = _composed()

    def close(s: Column) -> Column:
        """Base of a cluster with its ordered marks, composed where a composed letter exists."""
        return F.aggregate(F.sort_array(s["open"]), s["base"], lambda a, m: F.coalesce(F.try_element_at(composed, F.concat(a, m["part"])), F.concat(a, m["part"])))

    def step(s: Column, p: Column) -> Column:
        mark = p["ccc"] > 0
        return F.struct(
            F.when(mark, s["done"]).otherwise(F.concat(s["done"], F.array(close(s)))).alias("done"),
            F.when(mark, F.concat(s["open"], F.array(F.struct(p["ccc"].alias("ccc"), F.size(s["open"]).alias("n"), p["part"].alias("part"))))).otherwise(F.array().cast("array<struct<ccc:int,n:int,part:string>>")).alias("open"),
            F.when(mark, s["base"]).otherwise(F.coalesce(p["part"], F.lit(""))).alias("base"),
            (s["lone"] | (mark & p["pos"].isNotNull())).alias("lone"),
        )

    folded = listed.withColumn("f", F.aggregate("ps", start, step, lambda s: F.struct(F.array_join(F.concat(s["done"], F.array(close(s))), "").alias("run"))))
    # Mixed scripts: the minority follows the majority if every letter of it has a twin there.
    run = F.col("f.run")
    n_lat, n_cyr, n_grk = _count(run, _LAT), _count(run, _CYR), _count(run, r"\p{IsGreek}")
    cyr_twins, lat_twins, grk_lat, grk_cyr = _count(run, "".join(CYRILLIC_LATIN)), _count(run, "".join(LATIN_CYRILLIC)), _count(run, "".join(GREEK_LATIN)), _count(run, "".join(GREEK_CYRILLIC))
    to_lat = ((n_cyr == cyr_twins) & (n_grk == grk_lat) & (n_lat > 0) & (n_cyr + n_grk > 0) & (n_lat + n_cyr + n_grk >= 3) & ((n_lat >= n_cyr) | (n_lat > lat_twins))) | (F.col("stray") == "latin")
    to_cyr = ((n_lat == lat_twins) & (n_grk == grk_cyr) & (n_cyr > 0) & (n_lat + n_grk > 0) & (n_lat + n_cyr + n_grk >= 3) & ((n_cyr > n_lat) | (n_cyr > cyr_twins))) | (F.col("stray") == "cyrillic")
    to_lat_text = F.translate(F.translate(run, *_pairs(CYRILLIC_LATIN)), *_pairs(GREEK_LATIN))
    to_cyr_text = F.translate(F.translate(run, *_pairs(LATIN_CYRILLIC)), *_pairs(GREEK_CYRILLIC))
    has_mark = F.exists("ps", lambda p: (p["ccc"] > 0) & (p["sub"] == 0) & p["part"].rlike(r"[̀-ͯ]"))
    fixed = folded.select("rid", "at", (F.col("variant") | has_mark | to_cyr | to_lat).alias("variant"), F.when(to_cyr, to_cyr_text).when(to_lat, to_lat_text).otherwise(run).alias("fixed"))

    by_text = fixed.groupBy("rid").agg(F.max("variant").alias("variant"), F.map_from_entries(F.collect_list(F.struct("at", "fixed"))).alias("fixes"))
    return rows, by_text


def canonical(texts: DataFrame) -> DataFrame:
    """texts: record_kind, record_key, text. Adds clean (the consistent form) and variant (whether a character made a case); one row per distinct input row."""
    rows, by_text = _fixes(texts)
    out = rows.distinct().join(by_text, "rid", "left")
    clean = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(f"({RUNS})"), 0), lambda x, i: F.coalesce(F.try_element_at(F.col("fixes"), i), x)), "")
    return out.select("record_kind", "record_key", "text", F.when(F.col("fixes").isNotNull(), clean).otherwise(F.col("text")).alias("clean"), F.coalesce("variant", F.lit(False)).alias("variant"))


def records(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """chunks.text and query_entities.name as (record_kind, record_key, text)."""
    return chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_key"), "text").unionByName(entities.select(F.lit("query_entity").alias("record_kind"), F.col("qe_id").cast("string").alias("record_key"), F.col("name").alias("text")))


def found(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_kind, record_key) of each record that holds a variant character."""
    rows, by_text = _fixes(records(chunks, entities))
    return rows.select("record_kind", "record_key", "rid").join(by_text.filter("variant").select("rid"), "rid").select("record_kind", "record_key").distinct()


def titled(entities: DataFrame, titles: DataFrame) -> DataFrame:
    """Entity names in consistent form with the title they meet: (qe_id, name, clean, title_id). Titles are compared in upper case; the smallest title_id of equal titles counts."""
    names = canonical(entities.select(F.lit("query_entity").alias("record_kind"), F.col("qe_id").cast("string").alias("record_key"), F.col("name").alias("text")))
    keys = titles.groupBy(F.upper("title").alias("key")).agg(F.min("title_id").alias("title_id"))
    return names.select(F.col("record_key").cast("long").alias("qe_id"), F.col("text").alias("name"), "clean", F.upper("clean").alias("key")).join(keys, "key", "left").select("qe_id", "name", "clean", "title_id")
