"""Sources and sinks: whole texts, JSON lines, JSON documents, YAML settings, gold pages, Markdown exports and tables, GraphML, resumable and atomic writes.

Schemas are given, never inferred; malformed lines fail the read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row a file; doc_id is the file's name without its ending."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON document a row as text: nested values stay nested."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list under key of a YAML file as a small table; PyYAML is looked for here only."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([tuple(row.values()) if isinstance(row, dict) else (row,) for row in yaml.safe_load(f).get(key) or []], schema)


def read_gold_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, raw, gold, units, terms): a directory of name.raw.md, name.gold.md, name.units.txt, name.terms.txt; missing lists are empty."""
    files = spark.read.text(f"{path}/*", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.(raw|gold|units|terms)\.\w+$", 1).alias("name"), F.regexp_extract("_metadata.file_name", r"^(.*)\.(raw|gold|units|terms)\.\w+$", 2).alias("part"), "value").filter("name <> ''")
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    p = files.groupBy("name").pivot("part", ["raw", "gold", "units", "terms"]).agg(F.first("value"))
    return p.select("name", "raw", "gold", lines(F.col("units")).alias("units"), lines(F.col("terms")).alias("terms"))


def export_markdown(df: DataFrame, path: str, key: str = "chunk_id", text: str = "text", longest: int = 1_000_000) -> None:
    """One Markdown file for each key in a directory of its own; texts above longest are refused; what stood there is replaced."""
    over = df.filter(F.length(text) > longest).select(key).limit(1).collect()
    if over:
        raise ValueError(f"text of {over[0][0]} is longer than {longest}")
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("compression", "none").text(path)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of gzipped GraphML fragments, nodes before edges; vectors (column x) as blank-separated numbers of five decimals."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = F.array_join(F.transform("x", lambda v: F.format_string("%.5f", v.cast("double"))), " ") if "x" in vertices.columns else F.lit("")
    nodes = vertices.select(F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('"><data key="x">'), data, F.lit("</data></node>")).alias("value"))
    links = edges.select(F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    nodes.write.mode("overwrite").option("compression", "gzip").text(f"{path}/nodes")
    links.write.mode("overwrite").option("compression", "gzip").text(f"{path}/edges")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (name), edges (src, dst, weight)) of GraphML files or of what write_graphml left."""
    text = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value"))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    nodes = text.filter(F.col("value").contains("<node ")).select(plain(F.regexp_extract("value", r'<node id="([^"]*)"', 1)).alias("name"))
    e = text.filter(F.col("value").contains("<edge "))
    links = e.select(plain(F.regexp_extract("value", r'source="([^"]*)"', 1)).alias("src"), plain(F.regexp_extract("value", r'target="([^"]*)"', 1)).alias("dst"), F.expr("""try_cast(regexp_extract(value, 'key="weight">([^<]*)<', 1) as double)""").alias("weight"))
    return nodes, links


def markdown_table(rows: Iterable[dict], title: str = "") -> str:
    """Rows of a small result as a Markdown table: nested values by dotted names, four significant digits, a dash for null, pipes escaped, lists cut at eight."""

    def flat(d: dict, head: str = "") -> dict:
        out = {}
        for k, v in d.items():
            out |= flat(v, f"{head}{k}.") if isinstance(v, dict) else {head + str(k): v}
        return out

    def cell(v) -> str:
        if v is None:
            return "—"
        if isinstance(v, float):
            return f"{v:.4g}"
        if isinstance(v, (list, tuple)):
            return ", ".join(map(cell, v[:8])) + (", …" if len(v) > 8 else "")
        return str(v).replace("|", r"\|")

    flats = [flat(r) for r in rows]
    names = list(dict.fromkeys(k for r in flats for k in r))
    lines = [f"| {' | '.join(names)} |", "|" + "---|" * len(names), *(f"| {' | '.join(cell(r.get(n)) for n in names)} |" for r in flats)]
    return "\n".join(([f"# {title}", ""] if title else []) + lines)


def read_decimal_comma(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV parted by semicolons with decimal commas; columns: name -> type."""
    raw = spark.read.option("header", "true").option("sep", ";").csv(path)
    by = {re.sub("^﻿", "", c): c for c in raw.columns}
    return raw.select(*[(F.regexp_replace(F.col(f"`{by[n]}`"), ",", ".") if k in ("double", "float") else F.col(f"`{by[n]}`")).cast(k).alias(n) for n, k in columns.items()])


def append_missing(df: DataFrame, path: str, keys: list[str], same: str | None = None) -> DataFrame:
    """Append the rows whose keys are not at path yet and return them; if same is given, a value of it that differs from what is there is refused."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    if done is None:
        df.write.parquet(path)
        return df
    if same and not df.select(same).distinct().join(done.select(same).distinct(), same, "left_anti").isEmpty():
        raise ValueError(f"{same} differs from the rows at {path}")
    fresh = df.join(done.select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def replace_file(path: str, payload: dict | list) -> None:
    """A small JSON file, written beside and renamed, so that readers see the old or the new one whole."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=1)
    os.replace(beside, path)
