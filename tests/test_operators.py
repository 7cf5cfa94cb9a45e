import math
import random
import time

import pytest
from pyspark.sql import functions as F

from kiln.functions import text as T
from kiln.functions.providers import HashingEmbedder, answer, embed
from kiln.operators import blocks as B
from kiln.operators import chunking as K
from kiln.operators import cleaning as C
from kiln.operators import evaluation as E
from kiln.operators import graph as G
from kiln.operators import normalization as N
from kiln.operators import quality as Q
from kiln.operators import rag as R
from kiln.operators import scans as S
from kiln.operators import vectors as V


def one(df):
    return df.collect()[0][0]


def test_block_offsets_round_trip(spark):
    text = "первый блок\n\nзаголовок\nend"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    rows = B.split_blocks(df, "k").collect()
    assert [(r.text, text[r.start_pos : r.end_pos]) for r in rows] == [(r.text, r.text) for r in rows] and len(rows) == 3


def test_markdown_grammar_keeps_formula_whole(spark):
    text = "para one\nline two\n\n$$\na = b\n\nc = d\n$$\n\n# Title\n\n$$\nopen"
    rows = sorted(B.parse_markdown(spark.createDataFrame([(1, text), (2, None)], "k int, text string"), "k").collect(), key=lambda r: r.idx)
    assert [r.kind for r in rows] == ["paragraph", "formula", "heading", "formula"]
    assert all(text[r.start_pos : r.end_pos] == r.text for r in rows) and "c = d" in rows[1].text


def test_merge_around_caption(spark):
    rows = [("c", 0, "paragraph", "The strip was cool-"), ("c", 1, "paragraph", "Figure 3 Grain size"), ("c", 2, "paragraph", "ed in air."), ("c", 3, "paragraph", "A new start.")]
    out = B.merge_broken(spark.createDataFrame(rows, "g string, idx int, kind string, text string"), "g", ["idx"]).orderBy("paragraph").collect()
    assert [r.text for r in out] == ["The strip was cooled in air.", "Figure 3 Grain size", "A new start."]


def test_ends_and_continues(spark):
    df = spark.createDataFrame([("See Fig.", "next"), ("Done.", "next"), ("of the", "Mill"), ("open", "Mill")], "a string, b string")
    got = df.select(T.ends_strictly(F.col("a")).alias("e"), T.continues(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (False, True), (False, False)]


def test_clean_and_audit(spark):
    df = spark.createDataFrame([(1, "Text [3, 4] with <b>mark</b>  and  break-\nage ."), (2, None)], "k int, text string")
    assert {r.k: r.clean for r in C.clean(df, "k").collect()} == {1: "Text with mark and breakage.", 2: None}
    assert "citations" in {r.rule for r in C.audit(df, "k").collect()}


def test_outside_math(spark):
    df = spark.createDataFrame([(1, "ABC $X_Y$ DEF")], "k int, text string")
    assert C.outside_math(df, "k", lambda x: F.lower(x)).first().rewritten == "abc $X_Y$ def"


def test_noise_counts_overlap_once(spark):
    df = spark.createDataFrame([(1, "aaXXbb"), (2, None)], "k int, text string")
    assert {r.k: r.n_noise for r in C.noise_characters(df, "k", ["aX|XX", "XXb", "aaX"]).collect()} == {1: 5, 2: 0}


def test_mask_is_inverted(spark):
    text = "a $x$ b $$y$$ c <table><td>$z$</td></table> 1 2"
    df = spark.createDataFrame([(text,), ("plain",)], "text string")
    m, s = N.mask(F.col("text"))
    assert all(r.text == r.back for r in df.withColumn("m", m).withColumn("s", s).select("text", N.unmask(F.col("m"), F.col("s")).alias("back")).collect())


def test_greek_macros_of_every_block(spark, sf, tmp_path):
    import re

    from kiln.plans import registry

    rows = [(1, r"\sigma_y and \alpha\beta"), (2, r"\mu m, \multicolumn, \varepsilon \epsilon"), (3, r"\Delta\delta \lambda=\tau/\omega \gamma"), (4, "plain"), (5, None)]
    spark.createDataFrame(rows, "block_id long, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/blocks.parquet").select("block_id", "text").distinct().collect()]
    for folder, blocks in ((str(tmp_path), rows), (sf, real)):
        want = {i: x and re.sub(r"\\([a-zA-Z]+)", lambda m: N.GREEK.get(m[1], m[0]), x) for i, x in blocks}
        assert {r.block_id: r.text for r in registry.queries()["greek_blocks"](spark, folder).collect()} == want


def test_annotation_keeps_its_distance(spark):
    df = spark.createDataFrame([(1, "ferrite and ferrite " + "x" * 50 + " ferrite")], "k int, text string")
    assert N.annotate(df, "k", {"ferrite": "alpha iron"}, distance=40).first().n == 2


def test_plural_fold(spark):
    df = spark.createDataFrame([(w,) for w in ("grains", "grain", "studies", "study", "boxes", "box", "gas", "glass")], "word string")
    assert {(r.word, r.lemma) for r in N.plurals(df).collect()} == {("grains", "grain"), ("studies", "study"), ("boxes", "box")}


def test_scans_equal_whole_windows(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), i // 7, i, rnd.choice([None, 1, 2, 3])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, seg int, k int, v int")
    out = S.running_last(df, "g", "seg", ["k"], F.col("v"), "last")
    out = S.running_sum(out, "g", "seg", ["k"], F.coalesce("v", F.lit(0)), "total")
    out = S.neighbour(out, "g", "seg", ["k"], {"nv": F.col("v"), "nk": F.col("k")})
    out = S.neighbour(out, "g", "seg", ["k"], {"pk": F.col("k")}, ahead=False)
    got = {r.k: (r.last, r.total, r.nv, r.nk, r.pk) for r in out.collect()}
    for g in ("a", "b", None):
        mine, last, total = [r for r in rows if r[0] == g], None, 0
        for i, (_, _, k, v) in enumerate(mine):
            last, total = v if v is not None else last, total + (v or 0)
            nxt, prev = (mine[i + 1] if i + 1 < len(mine) else None), (mine[i - 1] if i else None)
            assert got[k] == (last, total, nxt and nxt[3], nxt and nxt[2], prev and prev[2])


def test_token_windows_cover_and_overlap(spark):
    words = " ".join(f"w{i}" for i in range(300))
    n = len(words.split()) * 2
    w = K.token_windows(spark.createDataFrame([(1, words), (2, None), (3, "")], "k int, text string"), "k", size=120, overlap=20).orderBy("window").collect()
    assert w[0].first_token == 0 and all(b.first_token - a.first_token == 100 for a, b in zip(w, w[1:])) and w[-1].first_token + w[-1].n_tokens == n


def test_packing_loses_nothing_and_keeps_the_limit():
    rnd, blocks, at = random.Random(1), [], 0
    for i in range(80):
        kind = "heading" if i % 9 == 0 else "paragraph"
        text = " ".join("Wort%d ist hier." % j for j in range(2 if kind == "heading" else rnd.randint(1, 120)))
        blocks.append((kind, text, at, at + len(text)))
        at += len(text) + 1
    out = K.pack(blocks, 200, 60, 260)
    assert out[0][1] == 0 and out[-1][2] == at - 1 and all(n <= 300 for *_, n in out)
    assert all(0 <= b[1] - a[2] <= 1 for a, b in zip(out, out[1:]))


def test_range_joins(spark):
    rnd = random.Random(3)
    spans = [("b", i, s, s + rnd.randint(0, 5000)) for i in range(200) for s in [rnd.randint(0, 20000)]]
    cuts = [("b", rnd.randint(0, 25000)) for _ in range(30)]
    s = spark.createDataFrame(spans, "g string, k int, start_pos int, end_pos int")
    c = spark.createDataFrame(cuts, "g string, pos int")
    assert {(r.k, r.pos) for r in K.cut_spans(s, c, "g").collect()} == {(k, p) for _, k, a, b in spans for _, p in cuts if a < p < b}
    w = [("b", x, x + 6000) for x in range(0, 20000, 4000)]
    whole = {r.k for r in K.not_whole(s, spark.createDataFrame(w, "g string, start_pos int, end_pos int"), "g", "k").collect()}
    assert whole == {k for _, k, a, b in spans if not any(x <= a and b <= y for _, x, y in w)}


def random_graph(spark, n=40, m=45, seed=2):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    v = spark.createDataFrame([(f"v{i:02}",) for i in range(n)], "name string")
    e = spark.createDataFrame([(f"v{a:02}", f"v{b:02}", 1.0 + (a * b) % 3) for a, b in pairs], "src string, dst string, weight double")
    return v, e, {(f"v{a:02}", f"v{b:02}") for a, b in pairs}, [f"v{i:02}" for i in range(n)]


def parts(names, pairs):
    label = {n: n for n in names}
    for _ in names:
        for a, b in pairs:
            x = min(label[a], label[b])
            label[a] = label[b] = x
    return label


def test_components_bridges_articulation(spark):
    v, e, pairs, names = random_graph(spark)
    label = parts(names, pairs)
    assert {r.name: r.component for r in G.components(v, e).collect()} == label
    k = len(set(label.values()))
    brute = {p for p in pairs if len(set(parts(names, pairs - {p}).values())) > k}
    assert {(r.src, r.dst) for r in G.bridges(v, e).collect()} == brute
    cutting = {n for n in names if len(set(parts([x for x in names if x != n], {p for p in pairs if n not in p}).values())) > k - (label == parts(names, pairs) and sum(n in p for p in pairs) == 0)}
    assert {r.name for r in G.articulation(v, e).collect()} == cutting


def test_cycles_triangles_paths(spark):
    v, e, pairs, names = random_graph(spark, 20, 34, 5)
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}
    t = {(a, b, c) for a in names for b in near[a] for c in near[a] & near[b] if a < b < c}
    assert {tuple(r) for r in G.triangles(e).collect()} == t
    cycles = G.cycle_basis(v, e).collect()
    assert len(cycles) == len(pairs) - len(names) + len(set(parts(names, pairs).values()))
    d = {(r.seed, r.name): r.distance for r in G.bfs(e, spark.createDataFrame([("v00",)], "seed string"), 30).collect()}
    level, queue = {"v00": 0}, ["v00"]
    for x in queue:
        for y in sorted(near[x]):
            if y not in level:
                level[y] = level[x] + 1
                queue.append(y)
    assert {n: k for (_, n), k in d.items()} == level


def test_edge_merge_and_empty_graph(spark):
    r = spark.createDataFrame([("A", "B", 1.0, "x"), ("B", "A", 2.0, "y"), ("A", "A", 1.0, None), (None, "B", 1.0, "z")], "source string, target string, weight double, description string")
    e = G.build(r)
    assert {(x.src, x.dst, x.weight, x.merged, x.description) for x in e.collect()} == {("A", "B", 3.0, 2, "x\ny"), ("A", "A", 1.0, 1, "")}
    v = spark.createDataFrame([], "name string")
    assert G.components(v, e.limit(0)).count() == 0 and G.bridges(v, e.limit(0)).count() == 0 and G.triangles(e.limit(0)).count() == 0


def test_tfidf_by_hand(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "k int, words array<string>")
    got = {(r.k, r.term): r.tfidf for r in V.tfidf(d, "k").collect()}
    a, b = 2 * (math.log(3 / 2) + 1), 1.0
    assert got[1, "a"] == pytest.approx(a / math.hypot(a, b)) and got[2, "b"] == pytest.approx(1)


def test_topk_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = df.filter("vec_id % 20 = 0")
    got = {(r.query_id, r["rank"]): r.vec_id for r in V.topk(q, df, 3).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) or 1)
    vec = {k: v for k, v in rows if v}
    for k in (0, 20, 40):
        best = sorted((x for x in vec if x != k), key=lambda x: (-round(dot(vec[k], vec[x]), 6), x))[:3]
        assert [got[k, i + 1] for i in range(3)] == best


def test_weighted_concat_is_weighted_sum(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    h = df.select(V.weighted_concat([(F.col("a"), 0.3), (F.col("b"), 0.7)]).alias("h")).first().h
    assert sum(x * x for x in h) == pytest.approx(0.3 * 5 + 0.7 * 10)


def test_ranking_and_kappa(spark):
    h = spark.createDataFrame([("q1", 1, False), ("q1", 2, True), ("q2", 1, False)], "q string, rank int, relevant boolean")
    r = {x.q: x for x in E.ranking(h, "q").collect()}
    assert r["q1"].rr == 0.5 and r["q1"].hit_1 == 0 and r["q1"].hit_3 == 1 and r["q1"].ndcg == pytest.approx(1 / math.log2(3)) and r["q2"].rr == 0
    k = spark.createDataFrame([("g", True, True), ("g", True, False), ("g", False, False), ("g", False, False)], "g string, a boolean, b boolean")
    assert E.kappa(k, ["g"], "a", "b").first().kappa == pytest.approx(0.5)


def test_auc_against_pairs(spark):
    rnd = random.Random(6)
    rows = [("g", rnd.random() < 0.4, rnd.randint(0, 5) / 5) for _ in range(50)]
    pos, neg = [s for _, l, s in rows if l], [s for _, l, s in rows if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(spark.createDataFrame(rows, "g string, label boolean, score double"), ["g"]).first().auc == pytest.approx(want)


def test_cer_counts_characters_of_every_row(spark, sf, tmp_path):
    from kiln.plans import registry

    rows = [(1, "Walzgüte", "Walzgute"), (2, "при 900 °C", "при 9OO °С — x"), (3, "𝐀b", "b"), (4, None, "ab"), (5, "x", ""), (6, "x", None), (7, "ascii", "ascii")]
    spark.createDataFrame(rows, "audit_id long, before_text string, after_text string").write.parquet(f"{tmp_path}/audit_log.parquet")
    want = lambda rows: {i: E._distance(list(b), list(a or "")) / len(b) if b else None for i, a, b in rows if b is not None}
    assert {r.audit_id: r.cer for r in registry.queries()["char_error_rate"](spark, str(tmp_path)).collect()} == want(rows)
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/audit_log.parquet").select("audit_id", "before_text", "after_text").distinct().collect()]
    assert {r.audit_id: r.cer for r in registry.queries()["char_error_rate"](spark, sf).collect()} == want(real)


def test_wer_and_coverage(spark):
    df = spark.createDataFrame([(1, "a b c d", "a x c"), (2, "", "a"), (3, None, None)], "k int, truth string, text string")
    assert {r.k: r.wer for r in E.wer(df, "k", "truth", "text").collect()} == {1: 0.5, 2: None, 3: None}
    assert E.block_coverage(df.filter("k = 1"), "k", "truth", "truth").first().coverage == 1


def test_names(spark):
    df = spark.createDataFrame([("---",), ("12.5 MPa",), (r"\sigma",), ("It",), ("AB-123",), ("Grain size",)], "name string")
    assert [r[0] for r in df.select(Q.noise_labels(F.col("name"))).collect()] == [["punctuation", "broken"], ["number"], ["latex"], ["pronoun", "broken"], ["code"], []]
    d = spark.createDataFrame([("Slab",), ("SLABS",), ("slabs",), ("plate",)], "name string")
    assert Q.duplicate_names(d).first().names == "SLABS|Slab|slabs"


def test_contained_terms(spark):
    t = spark.createDataFrame([("grain size",), ("grain",), ("ain size",)], "term string")
    n = spark.createDataFrame([("mean grain sizes",)], "name string")
    assert {r.term: r.covered for r in Q.contained_terms(t, n).collect()} == {"grain size": True, "grain": True, "ain size": False}


def test_expansion_and_units(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "src string, dst string")
    s = spark.createDataFrame([("q", n, x) for n, x in (("A", 0.9), ("B", 0.5), ("C", 0.7), ("D", 0.1))], "question_id string, name string, score double")
    c = R.expand(spark.createDataFrame([("q", "A")], "question_id string, name string"), s, e, limit=3)
    assert [r.name for r in c.orderBy("position").collect()] == ["A", "B", "C"]
    m = spark.createDataFrame([("A", "u1"), ("B", "u1"), ("A", "u2"), ("D", "u3")], "name string, unit_id string")
    assert [(r.unit_id, r.support) for r in R.source_units(c, m, seeds=1).orderBy("rank").collect()] == [("u1", 2), ("u2", 1)]


def test_shortest_paths_of_every_queried_name(spark, sf):
    from kiln.plans import graph
    from kiln.plans.base import Tables

    t, near = Tables(spark, sf), {}
    for r in graph.edges(t).filter("src <> dst").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    want = set()
    for a in {r[0] for r in t.query_entities.filter("name is not null").select(F.upper(F.trim("name"))).collect()}:
        seen, at = {a}, {a}
        for d in range(4):
            want |= {(a, b, d) for b in at}
            at = {c for b in at for c in near.get(b, ())} - seen
            seen |= at
    got = graph.shortest_paths(t).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def expand_by_hand(seeds, scores, edges, limit, rounds=3):
    """seeds: names by question; scores by name; edges: pairs. (question, name, position)."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    order, out = lambda names: sorted(names, key=lambda n: (-scores.get(n, 0), n)), set()
    for q, names in seeds.items():
        chosen = frontier = order(names)[:limit]
        for _ in range(rounds):
            frontier = order({m for n in frontier for m in near.get(n, ())} - set(chosen))[: limit - len(chosen)]
            chosen = chosen + frontier
        out |= {(q, n, i) for i, n in enumerate(chosen, 1)}
    return out


def test_expansion_with_scores_by_name(spark):
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(60)}", f"v{int(60 * rng.random() ** 3)}") for _ in range(220)]
    scores = {f"v{i}": float(rng.randrange(5)) for i in range(50)}
    seeds = {f"q{i}": {f"v{rng.randrange(70)}" for _ in range(rng.randrange(1, 9))} for i in range(40)}
    s = spark.createDataFrame([(q, n) for q, names in seeds.items() for n in names], "question_id string, name string")
    got = R.expand(s, spark.createDataFrame(list(scores.items()), "name string, score double"), spark.createDataFrame(edges, "src string, dst string"), limit=6)
    assert {tuple(r) for r in got.collect()} == expand_by_hand(seeds, scores, edges, 6)


def test_contexts_hold_every_question_and_seed(spark, sf):
    from kiln.plans import evaluation, graph
    from kiln.plans.base import Tables

    t = Tables(spark, sf)
    seeds, edges = {}, [(r.src, r.dst) for r in graph.edges(t).collect()]
    for r in t.query_entities.filter("name is not null").select("question_id", F.upper(F.trim("name")).alias("name")).collect():
        seeds.setdefault(r.question_id, set()).add(r.name)
    degree = {r.name: r.degree for r in G.degrees(graph.names(t), graph.edges(t)).collect()}
    want = expand_by_hand(seeds, degree, edges, 12)
    assert {tuple(r) for r in evaluation.context_expand(t).collect()} == want
    assert {r.question_id for r in evaluation.context_text(t).collect()} == set(seeds)
    context = {}
    for q, n, i in want:
        context.setdefault(q, {})[n] = i
    assert {(r.question_id, r.unit_id, r.support, r["rank"]) for r in evaluation.source_unit_support(t).collect()} == support_by_hand(context, seeds)


def support_by_hand(context, names, seeds=3, top=2):
    """context: positions by name, by question; names: those a unit mentions. (question, unit, support, rank)."""
    out = set()
    for q, c in context.items():
        first = {n for n, i in c.items() if i <= seeds}
        ranked = sorted((-len(c.keys() & m), u) for u, m in names.items() if first & m)
        out |= {(q, u, -k, i) for i, (k, u) in enumerate(ranked[:top], 1)}
    return out


@pytest.mark.parametrize("top", [1, 2, 4])
def test_source_units_of_frequent_names(spark, top):
    rng = random.Random(top)
    units = {f"u{i}": {f"v{int(20 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 6))} for i in range(60)}
    context = {f"q{i}": {n: k for k, n in enumerate(rng.sample([f"v{j}" for j in range(24)], rng.randrange(1, 9)), 1)} for i in range(40)}
    c = spark.createDataFrame([(q, n, k) for q, x in context.items() for n, k in x.items()], "question_id string, name string, position int")
    m = spark.createDataFrame([(n, u) for u, x in units.items() for n in x], "name string, unit_id string")
    assert {(r.question_id, r.unit_id, r.support, r["rank"]) for r in R.source_units(c, m, top=top).collect()} == support_by_hand(context, units, top=top)


def test_evidence_with_and_without_book(spark):
    q = spark.createDataFrame([("q1", "b1", ["grain", "cold"]), ("q2", "b1", []), ("q3", None, ["grain"])], "question_id string, book string, evidence array<string>")
    u = spark.createDataFrame([("u1", "b1", "Cold grain"), ("u2", "b2", "grain is cold"), ("u3", "b1", "grain")], "unit_id string, book string, text string")
    assert {tuple(r) for r in R.all_evidence(q, u).collect()} == {("q1", "u1")}
    assert {tuple(r) for r in R.all_evidence(q, u, False).collect()} == {("q1", "u1"), ("q1", "u2"), ("q3", "u1"), ("q3", "u2"), ("q3", "u3")}


def test_evidence_anywhere_is_containment(spark):
    q = [("q1", ["schmelze"]), ("q2", ["неплоскос"]), ("q3", ["°"]), ("q4", ["--", "Grain"]), ("q5", [""]), ("q6", ["e c", "old"]), ("q7", ["(a)\n(b)"]), ("q8", ["𝐀b"]), ("q9", ["schmelze"]), ("q9", ["°"]), ("q10", ["SCHMELZE", "schmelze"]), ("q11", ["x", None])]
    u = [("u1", "Stahlschmelzebad"), ("u2", "о неплоскостности -- grains"), ("u3", "900 °C"), ("u4", "The cold ( a)"), ("u5", "x(a)\n(b)"), ("u6", "z𝐀bc"), ("u7", ""), ("u8", "Schmelze at 5°"), ("u9", None)]
    got = R.all_evidence(spark.createDataFrame([(i, None, e) for i, e in q], "question_id string, book string, evidence array<string>"), spark.createDataFrame([(i, "b", x) for i, x in u], "unit_id string, book string, text string"), False).collect()
    want = {(i, j) for i, e in q for j, x in u if x is not None and None not in e and all(w.lower() in x.lower() for w in e)}
    assert ("q1", "u1") in want and len(got) == len(want) and {tuple(r) for r in got} == want


def test_evidence_anywhere_against_brute_force(spark, sf):
    from kiln.plans import evaluation
    from kiln.plans.base import Tables

    t = Tables(spark, sf)
    units = {(r.chunk_id, r.text.lower()) for r in t.chunks.filter("text is not null").select("chunk_id", "text").collect()}
    asked = [(r.question_id, [e.lower() for e in r.evidence]) for r in t.questions.filter("size(evidence) > 0").collect()]
    got = evaluation.evidence_anywhere(t).collect()
    assert {tuple(r) for r in got} == {(q, u) for q, e in asked for u, x in units if all(w in x for w in e)}
    assert len(set(map(tuple, got))) == len(got)


def test_answers_in_fences_and_tuples(spark):
    df = spark.createDataFrame([(1, 'Sure:\n```json\n{"a": 5}\n```'), (2, "none")], "k int, text string")
    assert {r.k: r.parsed and r.parsed.a for r in R.parse_json(df, "k", "a int").collect()} == {1: 5, 2: None}
    t = spark.createDataFrame([(1, '("entity"<|>"A"<|>"X"<|>"d")##("relationship"<|>"A"<|>"B"<|>"r"<|>2)<|COMPLETE|>')], "k int, text string")
    assert {(r.kind, r.a, r.weight) for r in R.parse_tuples(t, "k").collect()} == {("entity", "A", None), ("relationship", "A", 2.0)}


def test_providers(spark):
    df = spark.createDataFrame([(1, "roll"), (2, "roll"), (3, None)], "k int, text string")
    v = {r.k: r.embedding for r in embed(df, "k", "text", HashingEmbedder(16)).collect()}
    assert v[1] == v[2] and v[3] is None
    got, fresh = answer(df, "k", "text", lambda p: p.upper())
    assert {r.k: r.answer for r in got.collect()} == {1: "ROLL", 2: "ROLL", 3: None} and fresh.count() == 1
    again, more = answer(df, "k", "text", lambda p: "x", fresh)
    assert more.count() == 0 and {r.answer for r in again.collect()} == {"ROLL", None}


def test_cycle_basis_of_a_dense_graph():
    """Triangles of a dense core, squares at vertices between two of it, and one long cycle, in a second or so; all cycles through all vertices take minutes."""
    r, names = random.Random(3), [f"v{i:04d}" for i in range(930)]
    pairs = {tuple(sorted(r.sample(names[:200], 2))) for _ in range(5000)}
    for n in names[200:900]:
        pairs |= {(m, n) for m in r.sample(names[:200], 2)}
    pairs |= {(names[0], names[900]), *zip(names[900:], names[901:]), (names[0], names[929])}
    began = time.process_time()
    got = G._cycles(names, sorted(pairs))
    assert time.process_time() - began < 20
    assert len(got) == len(pairs) - len(names) + 1 and got[-1][0] == 31 and {n for n, _ in got[:-1]} <= {3, 4, 5}
    assert all(len(members) == n for n, members in got)


@pytest.mark.parametrize("name", ["span_cut_range_join", "span_not_whole_anti"])
def test_exploded_positions_are_not_broadcast(spark, sf, name):
    from kiln.plans import registry

    df = registry.queries()[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.split("\n") if "Join" in line and "bucket" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_positions_far_beyond_the_spans(spark, tmp_path):
    """A book whose last position is near the end of the integers: no table of all its cuts or windows."""
    from kiln.plans import registry

    last, at = 2_100_000_500, 2_099_999_990
    books = [f"b{i}" for i in range(80)]
    spark.createDataFrame([(b + "c", b, at, last) for b in books], "chunk_id string, book string, start_pos int, end_pos int").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = [(10 * i + k, b + "c", b, x, y) for i, b in enumerate(books) for k, (x, y) in enumerate([(0, 5), (5, 15), (9, 11), (11, 1500)])]
    spark.createDataFrame(rows, "block_id long, chunk_id string, book string, start_pos int, end_pos int").write.parquet(f"{tmp_path}/blocks.parquet")
    began = time.time()
    cut = {(r.block_id, r.pos) for r in registry.queries()["span_cut_range_join"](spark, str(tmp_path)).collect()}
    assert cut == {(r[0], p) for r in rows for p in range(2_099_999_000, last, 1000) if at + r[3] < p < at + r[4]}
    whole = lambda x, y: at + y <= min((at + x) // 900, (last - 1) // 900) * 900 + 1200
    assert {r.block_id for r in registry.queries()["span_not_whole_anti"](spark, str(tmp_path)).collect()} == {r[0] for r in rows if not whole(r[3], r[4])}
    assert time.time() - began < 60


def test_evidence_of_many_questions_is_sought_once(spark):
    """20 000 questions of the same words in one book with 6000 units, few of which hold them; null ids, several lists of a question and a unit with two texts."""
    words = F.when(F.col("id") % 2 == 0, F.array(F.lit("Roll"), F.lit("nowhere"))).otherwise(F.array(F.lit("nowhere")))
    q = spark.range(20_000).select(F.col("id").cast("string").alias("question_id"), F.lit("b").alias("book"), words.alias("evidence"))
    more = spark.createDataFrame([("x", "b", ["strip 7 "]), ("x", "c", ["NOTHING"]), (None, "b", ["strip 7 "]), ("y", "b", ["strip", None]), ("z", None, ["strip"]), ("e", "b", [])], "question_id string, book string, evidence array<string>")
    text = F.concat(F.lit("strip "), F.col("id").cast("string"), F.repeat(F.lit(" nowher rolls no"), 200))
    u = spark.range(6000).select(F.col("id").cast("string").alias("unit_id"), F.lit("b").alias("book"), text.alias("text"))
    other = spark.createDataFrame([("7", "b", "strip 7 again"), ("r", "b", "rolls nowhere"), ("s", "b", "nowhere"), ("n", "b", None), ("c", "c", "nothing, strip 7 "), ("m", None, "strip")], "unit_id string, book string, text string")
    began = time.time()
    got = R.all_evidence(q.unionByName(more), u.unionByName(other)).collect()
    assert time.time() - began < 30 and len(got) == len(set(got))
    want = {(str(i), "r") for i in range(20_000)} | {(str(i), "s") for i in range(1, 20_000, 2)} | {("x", "7"), ("x", "c"), (None, "7")}
    assert {tuple(r) for r in got} == want


def test_searches_with_the_graph_in_every_task(spark):
    """A chain, a cycle with chords, a vertex alone and seeds outside the graph, against searches by joins; nothing is shuffled by pairs."""
    r = random.Random(4)
    chain = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(150)]
    ring = [(f"c{i:03d}", f"c{(i + 1) % 90:03d}") for i in range(90)] + [tuple(r.sample([f"c{i:03d}" for i in range(90)], 2)) for _ in range(20)]
    e = spark.createDataFrame([*chain, *ring, ("c000", "c000")], "src string, dst string")
    names = spark.createDataFrame(sorted({(n,) for p in chain + ring for n in p} | {("alone",)}), "name string")
    seeds = names.select(F.col("name").alias("seed")).union(spark.createDataFrame([("nowhere",)], "seed string"))
    want = {tuple(x) for x in G.bfs(e, seeds, 3).collect()}
    many = G.bfs_many(e, seeds, 3)
    got = [tuple(x) for x in many.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "Exchange hashpartitioning" not in many._jdf.queryExecution().executedPlan().toString()
    paths = {tuple(x) for x in G.path_lengths(names, e).collect()}
    G.NUMBERED, held = 5, G.NUMBERED
    try:
        ring_only = e.filter("src > 'b'")
        by_joins = {tuple(x) for x in G.path_lengths(names.filter("name > 'b' or name = 'alone'"), ring_only).collect()}
    finally:
        G.NUMBERED = held
    assert by_joins <= paths and {x for x in paths if x[0] == "a000"} == {("a000", 151, 150, 152 / 3)} and ("alone", 1, 0, 0.0) in paths and len(paths) == 3
