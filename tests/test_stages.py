import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import text as T
from kiln.operators import cleaning as C
from kiln.operators import evaluation as E
from kiln.operators import graph as G
from kiln.operators import linkmodel as L
from kiln.operators import normalization as N
from kiln.operators import pipeline as P
from kiln.operators import rag as R
from kiln.operators import similarity as S
from kiln.operators import vectors as V
from kiln.session import clear, clustered, cut, fine, groups, release


def test_planning_runs_no_job_and_cuts_are_deleted(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    fine(df), clustered(df, ("k",)), fine(df, by=("k",))
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    a = cut(df)
    path = a._cut_path
    assert a.count() == 7
    release(a)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    clear(spark)


def test_groups_over_batches():
    import pandas as pd

    rnd = np.random.default_rng(3)
    keys = np.sort(rnd.integers(0, 9, 60))
    df = pd.DataFrame({"k": keys, "v": np.arange(60)})
    for size in (1, 2, 7, 60):
        got = [(b.k.iloc[i], b.v.iloc[i:j].tolist()) for b, at in groups((df.iloc[a : a + size] for a in range(0, 60, size)), ("k",)) for i, j in zip(at, at[1:])]
        assert got == [(k, df.v[df.k == k].tolist()) for k in sorted(set(keys))]


def test_similar_names_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    words = ["ferrite grain", "ferritic grains", "rolling force", "rolling forces", "Прокат", "prokat", "Усилие прокатки", "usilie prokatki", "x"]
    names = sorted({w + s for w in words for s in ("", " a", "s", " II", " steel")} | {"".join(rnd.choice(list("abcde"), 6)) for _ in range(40)})
    df = spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "name string")

    def grams(n):
        t = " " + "".join(S.LATIN.get(c, c) for c in n.lower()) + " "
        return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}

    for t in (0.5, 0.8, 0.95):
        want = {(a, b) for a in names for b in names if a != b and len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 >= t - 1e-9}
        assert {(r.a, r.b) for r in S.similar(df, df, t).collect()} == want
    pairs = S.coreferent(df, 0.8, 0.8).collect()
    assert any(r.cross and {r.a, r.b} == {"Прокат", "prokat"} for r in pairs) and all(r.a < r.b for r in pairs)
    assert S.similar(df.limit(0), df, 0.5).count() == 0
    got = {r.term: (r.lexical, r.similar) for r in S.coverage(spark.createDataFrame([("grain",), ("ferritic grain",), ("zzz",)], "term string"), df, 0.7).collect()}
    assert got == {"grain": (True, True), "ferritic grain": (True, True), "zzz": (False, False)}


def test_trained_encoder_finds_communities(spark):
    rnd = np.random.default_rng(1)
    names = [f"v{i:03d}" for i in range(80)]
    x = {n: rnd.normal(0, 1, 8) + (3 * np.eye(8)[i % 4]) for i, n in enumerate(names)}
    edges = {tuple(sorted((names[i], names[j]))) for i in range(80) for j in rnd.integers(0, 80, 24) if i != j and i % 4 == j % 4}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    f = spark.createDataFrame([(n, v.tolist()) for n, v in x.items()], "name string, x array<double>")
    encoders = L.train(f, e, seeds=(0, 1), hidden=16)
    z = {r.name: np.array(r.x) for r in L.encode(f, e, encoders).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1, abs=1e-6) for v in z.values())
    pairs = [(i, j) for i in range(80) for j in range(i)]
    score, label = np.array([z[names[i]] @ z[names[j]] for i, j in pairs]), np.array([int(i % 4 == j % 4) for i, j in pairs])
    assert L.auc(score, label) > 0.95
    assert L.auc(np.array([1.0, 1.0, 0.0]), np.array([1, 0, 0])) == pytest.approx(0.75)
    assert L.encode(f, e.limit(0), L.train(f, e.limit(0), seeds=(0,))).count() == 80


def test_gradient_of_the_encoder():
    rnd = np.random.default_rng(2)
    m = L.Encoder(3, 4, 0)
    x, n = rnd.normal(size=(5, 3)), rnd.normal(size=(5, 3))
    src, dst, y = np.array([0, 1, 2]), np.array([3, 4, 0]), np.array([1.0, 0.0, 1.0])

    def loss():
        e = m.encode(x, n)
        c = 10 * (e[src] * e[dst]).sum(1)
        return float(np.mean(np.log1p(np.exp(c)) - y * c)) + L.DECAY / 2 * sum((p**2).sum() for p in m.p)

    g = m._step(x, n, src, dst, y)
    for k in (0, 1):
        for i, j in ((0, 0), (2, 3), (1, 2)):
            at = m.p[k][i, j]
            m.p[k][i, j] = at + 1e-6
            up = loss()
            m.p[k][i, j] = at - 1e-6
            down = loss()
            m.p[k][i, j] = at
            assert g[k][i, j] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_clean_book_composes_all_steps(spark):
    rows = [("b", 0, "heading", "# Cooling"), ("b", 1, "paragraph", "The strip is cooled [3] in the"), ("b", 2, "image", "![](x.png)"), ("b", 3, "paragraph", "water box."), ("b", 4, "paragraph", "THE BULLETIN"), ("b", 5, "paragraph", "- 7 -"), ("b", 6, "heading", "References"), ("b", 7, "paragraph", "1. Someone"), ("c", 0, "paragraph", "[4]"), ("c", 1, None, None)]
    df = spark.createDataFrame(rows, "book string, idx int, kind string, text string")
    heads = spark.createDataFrame([("b", "THE BULLETIN")], "book string, line string")
    clean, audit = P.clean_book(df, "book", ["idx"], heads)
    assert [r.text for r in clean.orderBy("book", "paragraph").collect()] == ["# Cooling", "The strip is cooled in the water box."]
    rules = {(r.book, r.rule) for r in audit.collect()}
    assert {("b", "reference_list"), ("b", "running_header"), ("b", "page_number"), ("b", "image_placeholder"), ("b", "merged_paragraph"), ("b", "citations"), ("c", "citations")} <= rules


def test_normalize_text_composes_all_steps(spark):
    t = "Temps of 900 град. and 20 мкм; $\\sigma grains$ stay. Above $A_{c3}$ the Grains grow, see Fig. 3; аустенит."
    df = spark.createDataFrame([("k", t), ("n", None), ("e", "")], "key string, text string")
    lexicon = spark.createDataFrame([("grains", "grain")], "word string, lemma string")
    got = {r.key: r.text for r in P.normalize_text(df, "key", lexicon, {"аустенит": "austenite"}, {"Fig.": "Figure"}, [C.Rule("ocr", "Temps", "Temperatures", True)]).collect()}
    assert got["k"] == "Temperatures of 900 °C and 20 μm; $σ grains$ stay. Above Ac3 the Grain grow, see Figure 3; austenite (аустенит)." and got["n"] is None and got["e"] == ""
    assert spark.createDataFrame([("5 кН and 3 ГПа at 2 °C/с, мас. %",)], "t string").select(N.normalize(F.col("t")).alias("t")).first().t == "5 kN and 3 GPa at 2 °C/s, wt.%"


def test_graph_criteria_and_bridges(spark):
    v = spark.createDataFrame([(n, "t", "en") for n in ("A1", "ROLLING FORCE", "ROLLING FORCES", "GRAIN", "LONER")], "name string, type string, lang string")
    e = spark.createDataFrame([("GRAIN", "ROLLING FORCE", 1.0), ("GRAIN", "ROLLING FORCES", 1.0), ("A1", "GRAIN", 1.0), ("ROLLING FORCE", "ROLLING FORCES", 1.0)], "src string, dst string, weight double")
    got = {r.criterion: r.value for r in P.evaluate_graph(v, e, spark.createDataFrame([("GRAIN",), ("NOTHING",)], "term string"), spark.createDataFrame([("GRAIN", "u1"), ("GRAIN", "u2")], "name string, unit_id string")).collect()}
    assert (got["vertices"], got["edges"], got["components"], got["triangles"], got["duplicate_groups"], got["isolated"]) == (5, 4, 2, 1, 1, 1)
    assert got["completeness_exact"] == 0.5 and got["mean_units"] == 2.0
    # A chain deeper than any bound of rounds before, with a cycle at its end.
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(36)] + [("n0034", "n0036")]
    c = spark.createDataFrame(chain, "src string, dst string")
    names = spark.createDataFrame(sorted({(n,) for p in chain for n in p}), "name string")
    assert {(r.src, r.dst) for r in G.bridges(names, c).collect()} == set(chain[:34])
    c, names = c.filter("src > 'n0028'"), names.filter("name > 'n0028'")
    small = G.path_lengths(names, c).first()
    G.MAX_COMPONENT, held = 5, G.MAX_COMPONENT
    try:
        assert G.path_lengths(names, c).first() == small
    finally:
        G.MAX_COMPONENT = held


def test_detection_variants_and_bytes(spark):
    rows = [("p", True, True, 10), ("p", True, False, 5), ("q", False, True, 5), ("q", None, True, 5), ("r", False, False, 1)]
    d = {r.page: r for r in E.detection(spark.createDataFrame(rows, "page string, pred boolean, gold boolean, k int"), ["page"], "pred", "gold", "k").collect()}
    assert d["p"].precision == 0.5 and d["p"].recall == 1.0 and d["q"].f1 == 0.0 and d["r"].f1 == 1.0 and d[None].weighted_f1 == pytest.approx((2 / 3 * 15 + 0 + 1) / 21)
    runs = [(v, r, "m", "share", x + 0.001 * r) for v, x in (("a", 0.5), ("b", 0.6), ("c", 0.51)) for r in range(3)]
    got = {r.variant: r.clear for r in E.variant_report(spark.createDataFrame(runs, "variant string, repeat int, metric string, kind string, value double"), "a").collect()}
    assert got == {"b": True, "c": False}
    texts = ["", "abc", "жба", "aж€😀b", "😀😀"]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(0, 12)], "t string, n int")
    for n in range(0, 12):
        for r in df.filter(f"n = {n}").select("t", T.clip_bytes(F.col("t"), n).alias("c")).collect():
            assert r.c == r.t.encode()[:n].decode(errors="ignore"), (r.t, n)


def test_first_object_and_ties(spark):
    assert R.first_object('So: {"a": {"b": 1}} and {"c": 2}') == '{"a": {"b": 1}}' and R.first_object("{x} {\"k\": 1}") == '{"k": 1}' and R.first_object("none") is None and R.first_object(None) is None
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = sorted((r["rank"], r.vec_id) for r in V.topk(df.filter("vec_id = 39"), df, 3).collect())
    assert got == [(1, 0), (2, 1), (3, 2)]
