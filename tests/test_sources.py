import datetime

from kiln.sources import files as S
from kiln.streaming import events as X


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "x < & y", 1.5), ("b", None, None)], "id string, text string, v double")
    S.write_jsonl(df, f"{tmp_path}/j")
    assert S.read_jsonl(spark, f"{tmp_path}/j", df.schema).exceptAll(df).isEmpty()
    S.write_json_document(df, f"{tmp_path}/d")
    S.export_markdown(df.filter("text is not null"), f"{tmp_path}/m", key="id")
    assert (tmp_path / "m" / "id=a").is_dir()
    v = spark.createDataFrame([('A "q" <b>', [0.1, 0.25])], "name string, x array<double>")
    e = spark.createDataFrame([('A "q" <b>', "B", 2.0)], "src string, dst string, weight double")
    S.write_graphml(v, e, f"{tmp_path}/g")
    nodes, links = S.read_graphml(spark, f"{tmp_path}/g")
    assert nodes.first().name == 'A "q" <b>' and tuple(links.first()) == ('A "q" <b>', "B", 2.0)


def test_texts_settings_and_pages(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.md").write_text("l1\nl2")
    assert tuple(S.read_texts(spark, f"{tmp_path}/t").first()) == ("one", "l1\nl2")
    (tmp_path / "c.yaml").write_text("rules:\n - {a: x, b: 1}\n")
    assert S.read_settings(spark, f"{tmp_path}/c.yaml", "rules", "a string, b int").first().b == 1
    (tmp_path / "g").mkdir()
    for part, text in (("raw.md", "r"), ("gold.md", "g"), ("units.txt", "MPa\n\nK")):
        (tmp_path / "g" / f"p1.{part}").write_text(text)
    p = S.read_gold_pages(spark, f"{tmp_path}/g").first()
    assert (p.raw, p.gold, p.units, p.terms) == ("r", "g", ["MPa", "K"], [])


def test_append_and_table(spark, tmp_path):
    a = spark.createDataFrame([(1, "j"), (2, "j")], "k int, judge string")
    S.append_missing(a, f"{tmp_path}/a", ["k"], "judge")
    fresh = S.append_missing(spark.createDataFrame([(2, "j"), (3, "j")], "k int, judge string"), f"{tmp_path}/a", ["k"], "judge")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 3 and fresh is not None
    try:
        S.append_missing(spark.createDataFrame([(4, "other")], "k int, judge string"), f"{tmp_path}/a", ["k"], "judge")
        raise AssertionError("mixed judges were taken")
    except ValueError:
        pass
    assert S.markdown_table([{"a": {"b": 1.23456}, "c": None, "d": "x|y"}]).splitlines()[-1] == r"| 1.235 | — | x\|y |"


def test_stream_equals_table(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch = batch.withColumn("ts", batch.ts.cast("timestamp"))
    streamed = X.drain(X.tumbling(X.stream(spark, sf)), "t_stream", "complete")
    assert streamed.count() == X.tumbling(batch).count()
    s = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, 0)), (1, datetime.datetime(2024, 1, 1, 0, 20)), (1, datetime.datetime(2024, 1, 1, 2, 0))], "user_id int, ts timestamp")
    assert sorted(r.n for r in X.sessions(s).collect()) == [1, 2]
