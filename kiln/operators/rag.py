"""Retrieval over a knowledge graph: evidence, query graphs, bonuses, context expansion, source units, context text.

Defined results: patterns that are null or no valid regular expression match nothing; an empty list of patterns is met by nothing unless a docstring says otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.graph import both
from kiln.session import cut

#: Characters of the runs by which evidence and units meet.
GRAM = 5
#: Runs of evidence that are broadcast at most; more are joined by a shuffle.
BROADCAST = 200_000
#: Words of the evidence of a book that a unit meets in a row.
WORDS = 256
#: Questions whose ids are broadcast at most; more are joined by a shuffle.
QUESTIONS = 1_000_000


def all_evidence(questions: DataFrame, units: DataFrame, match_book: bool = True) -> DataFrame:
    """(question_id, unit_id) where every evidence pattern of the question is in the unit's text, of the same book if match_book. questions: question_id, book, evidence (literal words); units: unit_id, book, text.

    With the book a unit meets the distinct words of its book's evidence once each; without it a run of GRAM characters of the evidence, which any text that holds the evidence holds too, meets the runs of the units by equality, so that no question is held against every unit.
    Evidence without a word that long is met by a run as long as its longest word.
    """
    q = questions.filter(F.size("evidence") > 0).select("question_id", "book", "evidence")
    u = units.select("unit_id", F.col("book").alias("unit_book"), "text").withColumn("low", F.lower("text"))
    return _in_book(q, u) if match_book else _anywhere(q, u)


def _in_book(questions: DataFrame, units: DataFrame) -> DataFrame:
    """all_evidence() within books. Questions of the same evidence in the same book are one; a word that several lists share is sought once a unit, the rest of a list only where its longest word is. What a unit has is gathered by its id as numbers, so that no pair of question and unit is shuffled."""
    clean = questions.filter(~F.exists("evidence", lambda e: e.isNull()) & F.col("book").isNotNull())
    lists = clean.select("question_id", "book", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: F.lower(e)))).alias("words"))
    asked = lists.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct("book", "words"))).alias("lists"))
    # In a struct, as an id may be null.
    members = cut(asked.groupBy("lists").agg(F.collect_list(F.struct("question_id")).alias("members")).withColumn("number", F.monotonically_increasing_id()))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    one = members.select("number", F.explode("lists").alias("l")).select("number", "l.book", "l.words").withColumn("word", longest)
    rest = F.filter("words", lambda w: w != F.col("word"))
    words = one.groupBy("book", "word").agg(F.collect_list(F.struct(rest.alias("rest"), "number")).alias("lists"))
    part = F.floor((F.row_number().over(Window.partitionBy("book").orderBy("word")) - 1) / WORDS)
    keys = words.withColumn("part", part).groupBy(F.col("book").alias("unit_book"), "part").agg(F.collect_list(F.struct("word", "lists")).alias("keys"))
    near = F.flatten(F.transform(F.filter("keys", lambda k: F.contains(F.col("low"), k["word"])), lambda k: k["lists"]))
    whole = F.filter(near, lambda x: F.forall(x["rest"], lambda w: F.contains(F.col("low"), w)))
    met = units.join(_small(cut(keys)), "unit_book").select("unit_id", F.transform(whole, lambda x: x["number"]).alias("numbers")).filter(F.size("numbers") > 0)
    found = met.groupBy("unit_id").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    all_members = members.select("number", "members")
    all_members = F.broadcast(all_members) if questions.count() <= QUESTIONS else all_members
    pairs = found.select("unit_id", F.explode("numbers").alias("number")).join(all_members, "number")
    return pairs.select("unit_id", F.explode("members").alias("m")).select("m.question_id", "unit_id")


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters; one empty run for 0."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _anywhere(questions: DataFrame, units: DataFrame) -> DataFrame:
    """all_evidence() without the book. Questions of the same evidence are checked once, under the smallest id of them; a question with several lists is met by any of them."""
    clean = questions.filter(~F.exists("evidence", lambda e: e.isNull()) & F.col("question_id").isNotNull())
    lists = clean.select("question_id", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: F.lower(e)))).alias("evidence"))
    asked = lists.groupBy("question_id").agg(F.array_sort(F.collect_set("evidence")).alias("lists"))
    members = cut(asked.join(asked.groupBy("lists").agg(F.min("question_id").alias("rep")), "lists").select("rep", "question_id", "lists"))
    one = members.filter("rep = question_id").select("rep", F.explode("lists").alias("evidence"))
    one = cut(one.withColumn("n", F.least(F.lit(GRAM), F.array_max(F.transform("evidence", lambda e: F.length(e))))))
    sizes = [r.n for r in one.select("n").distinct().collect()]  # at most GRAM + 1
    if not sizes:
        return members.join(units.select("unit_id"), F.lit(False)).select("question_id", "unit_id")
    runs = lambda c: F.flatten(F.array(*[_grams(c, n) for n in sizes]))
    within = lambda n: F.flatten(F.transform("evidence", lambda e: _grams(e, n)))
    own = F.coalesce(*[F.when(F.col("n") == n, within(n)) for n in sizes])
    keys = one.select("rep", "evidence", F.explode(F.array_distinct(own)).alias("gram"))
    # Any run finds all units; how often it occurs in an eighth of them only tells which run leaves the fewest to check.
    some = units.filter(F.pmod(F.xxhash64("unit_id"), F.lit(8)) == 0).select(F.explode(runs(F.col("low"))).alias("gram"))
    wanted = _small(cut(keys.select("gram").distinct()))
    df = some.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rare = keys.join(df, "gram", "left").groupBy("rep", "evidence").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)).alias("d"), "gram")).alias("gram"))
    met = units.select("unit_id", "low", F.explode(runs(F.col("low"))).alias("gram")).join(_small(cut(rare)), "gram")
    found = met.filter(F.forall("evidence", lambda e: F.contains(F.col("low"), e))).select("rep", "unit_id").distinct()
    return found.join(members.select("rep", "question_id"), "rep").select("question_id", "unit_id")


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has at most BROADCAST rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def valid_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (question_id, source, target) of a query graph whose two ends are entities (question_id, name) of the same question and differ."""
    e = entities.select("question_id", "name").distinct()
    return relations.filter("source <> target").join(e.withColumnRenamed("name", "source"), ["question_id", "source"], "left_semi").join(e.withColumnRenamed("name", "target"), ["question_id", "target"], "left_semi")


def with_fallback(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, name): entities of each question; a question without any has its own text as entity."""
    e = entities.filter("name is not null").select("question_id", "name").distinct()
    return e.unionByName(questions.select("question_id", F.col("question").alias("name")).distinct().join(e, "question_id", "left_anti"))


def relation_bonus(candidates: DataFrame, wanted: DataFrame, edges: DataFrame, direct: float = 0.1, common: float = 0.05) -> DataFrame:
    """(question_id, name, bonus): for candidates (question_id, query_name, name) of the two ends of a wanted relation (question_id, source, target), direct where an edge ties them, common where they share a neighbour; the best counts once."""
    pairs = cut(both(edges))
    a = wanted.join(candidates.select("question_id", F.col("query_name").alias("source"), F.col("name").alias("x")), ["question_id", "source"])
    ab = a.join(candidates.select("question_id", F.col("query_name").alias("target"), F.col("name").alias("y")), ["question_id", "target"]).filter("x <> y").select("question_id", "x", "y").distinct()
    edge = ab.join(pairs.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"], "left_semi").withColumn("b", F.lit(direct))
    two = ab.join(pairs.select(F.col("src").alias("x"), F.col("dst").alias("m")), "x").join(pairs.select(F.col("src").alias("m"), F.col("dst").alias("y")), ["m", "y"], "left_semi").select("question_id", "x", "y").distinct().withColumn("b", F.lit(common))
    best = edge.select("question_id", "x", "y", "b").unionByName(two)
    ends = best.select("question_id", F.col("x").alias("name"), "b").unionByName(best.select("question_id", F.col("y").alias("name"), "b"))
    return ends.groupBy("question_id", "name").agg(F.max("b").alias("bonus"))


def expand(seeds: DataFrame, scores: DataFrame, edges: DataFrame, limit: int = 30, rounds: int = 3) -> DataFrame:
    """(question_id, name, position): seeds (question_id, name) by score, then round by round their neighbours by score and name until limit. scores: (question_id, name, score), or (name, score) for all questions; a missing score counts 0."""
    pairs = cut(both(edges))
    on = [c for c in ("question_id", "name") if c in scores.columns]
    scored = lambda df: df.join(scores, on, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if on == ["name"]:
        # At most limit names are chosen before a round and that many fewer are added in it, so the best limit neighbours of a vertex hold all that it can add.
        best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "name"))
        pairs = cut(scored(pairs.withColumnRenamed("dst", "name")).withColumn("k", best).filter(F.col("k") <= limit).select("src", F.col("name").alias("dst")))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "name")
    have = scored(seeds.select("question_id", "name").distinct())
    chosen = cut(have.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select("question_id", "name", "position"))
    frontier = chosen
    for _ in range(rounds):
        near = frontier.join(pairs.withColumnRenamed("src", "name"), "name").select("question_id", F.col("dst").alias("name")).distinct().join(chosen, ["question_id", "name"], "left_anti")
        last = chosen.groupBy("question_id").agg(F.max("position").alias("last"))
        frontier = cut(scored(near).withColumn("k", F.row_number().over(w)).join(last, "question_id").withColumn("position", F.col("k") + F.col("last")).filter(F.col("position") <= limit).select("question_id", "name", "position"))
        if frontier.isEmpty():
            break
        chosen = chosen.unionByName(frontier)
    return chosen


def source_units(context: DataFrame, mentions: DataFrame, seeds: int = 3, top: int = 2) -> DataFrame:
    """(question_id, unit_id, support, rank): units that mention one of the first seeds positions, by how many context names they mention; ties go to the smaller unit. mentions: (name, unit_id)."""
    m = mentions.filter("unit_id is not null").distinct()
    first, other = context.filter(F.col("position") <= seeds).select("question_id", "name"), F.col("name").alias("other")
    # Names are frequent, pairs of names are not. Units with two names of the context come by pairs, all of them; among the top smallest units of a name at most as many are of those, so the rest hold all of support 1 that can be in the top.
    few = m.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("unit_id"))).filter(F.col("k") <= top)
    wanted = first.join(context.select("question_id", other), "question_id").filter("name <> other")
    pairs = m.join(m.select("unit_id", other), "unit_id").filter("name <> other")
    pool = first.join(few, "name").select("question_id", "unit_id").unionByName(wanted.join(pairs, ["name", "other"]).select("question_id", "unit_id")).distinct()
    support = pool.join(m, "unit_id").join(context.select("question_id", "name"), ["question_id", "name"], "left_semi").groupBy("question_id", "unit_id").agg(F.countDistinct("name").alias("support"))
    return support.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("support"), "unit_id"))).filter(F.col("rank") <= top)


def clip(text: Column, n: int) -> Column:
    """At most n characters; an ellipsis marks what is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def context_text(context: DataFrame, descriptions: DataFrame, n: int = 250, whole: int = 5000) -> DataFrame:
    """(question_id, context): lines 'name: description' in the order of the context, each clipped to n characters, the whole to whole."""
    one = descriptions.groupBy("name").agg(F.min("description").alias("description"))
    lines = context.join(one, "name", "left").withColumn("line", F.concat("name", F.lit(": "), clip(F.coalesce("description", F.lit("")), n)))
    listed = lines.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    return listed.select("question_id", clip(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), whole).alias("context"))


def parse_tuples(texts: DataFrame, key: str, text: str = "text", field: str = "<|>", record: str = "##", done: str = "<|COMPLETE|>") -> DataFrame:
    """(key, kind, a, b, c, weight): records of an extraction answer: ("entity", name, type, description) and ("relationship", source, target, description, weight), parted by record, ended by done."""
    body = F.split(F.replace(F.col(text), F.lit(done), F.lit("")), record)
    parts = texts.select(key, F.explode(body).alias("r")).withColumn("f", F.split(F.regexp_replace(F.trim("r"), r'^\(|\)$', ""), field.replace("|", r"\|")))
    f = lambda i: F.trim(F.regexp_replace(F.get("f", F.lit(i)), '^\\s*"|"\\s*$', ""))
    return parts.select(key, f(0).alias("kind"), f(1).alias("a"), f(2).alias("b"), f(3).alias("c"), F.expr("try_cast(trim(get(f, 4)) as double)").alias("weight")).filter(F.col("kind").isin("entity", "relationship"))


def first_object(text: str | None) -> str | None:
    """The first JSON object of a text, whatever stands before and after it; null where there is none."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def parse_json(texts: DataFrame, key: str, schema: str, text: str = "text") -> DataFrame:
    """(key, parsed): the first JSON object of an answer with fences or a preamble; null where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "_json": pd.Series([first_object(t) for t in b[text]], dtype=object)})

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, _json string").select(key, F.from_json("_json", schema).alias("parsed"))
