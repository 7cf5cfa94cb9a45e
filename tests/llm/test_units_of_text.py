"""Parsers, classifiers and searches against brute force and exact results on small inputs."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import consensus, leak, lookalike, markup, mixture, pairs, scan, tokens, toxic
from kiln.llm.gbt import Boosted
from kiln.llm.skeleton import fold, plain


def test_boosted_learns_xor():
    rnd = np.random.default_rng(1)
    x = rnd.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = Boosted(1, rounds=30, depth=3).fit(x[:400], y[:400])
    assert ((m.prob(x[400:])[:, 0] > 0.5) == y[400:]).mean() > 0.95
    k = Boosted(3, rounds=20, depth=3).fit(x[:400], (x[:400, 2] * 3).astype(int))
    assert (k.prob(x[400:]).argmax(1) == (x[400:, 2] * 3).astype(int)).mean() > 0.9


# --- markup -----------------------------------------------------------------------------------------------------------------------------

PLAIN = ["The strip cools evenly on the table before the next pass.", "Grain size follows the finishing temperature in most trials.", "Die Walzkraft steigt mit der Abnahme und der Breite.", "Размер зерна зависит от температуры конца прокатки."] * 30


@pytest.fixture(scope="module")
def tree():
    return markup.train(PLAIN)


def kind_of(tree, text):
    nodes, feats, parents = markup.flatten(text)
    kinds = markup.decode(np.log(tree.prob(np.array(feats)) + 1e-9), parents)
    return markup.CLASSES[kinds[0]], markup.render(nodes, kinds)


@pytest.mark.parametrize(
    "text, kind, clean",
    [
        ("<h2>Cooling practice</h2>", "heading", "# Cooling practice"),
        ("### Cooling practice ###", "heading", "# Cooling practice"),
        ("== Cooling practice ==", "heading", "# Cooling practice"),
        ("\\subsection*{Cooling practice}", "heading", "# Cooling practice"),
        ("<p>The <b>strip</b> cools<sup>3</sup> evenly.</p>", "paragraph", "The strip cools evenly."),
        ("The [[strip|strip]] cools ''evenly'' on the \\emph{table}~.", "paragraph", "The strip cools evenly on the table."),
        ("- one item\n- another item", "list", "- one item\n- another item"),
        ("<ol>\n  <li>one item</li>\n  <li>another</li>\n</ol>", "list", "- one item\n- another"),
        ("# one item of the list\n# another item of the list", "list", "- one item of the list\n- another item of the list"),
        ("```python\nx = 1\nfor i in y:\n    x = f(x)\n```", "code", "x = 1\nfor i in y:\n    x = f(x)"),
        ("\\begin{equation}\na = b + c\n\\end{equation}", "formula", "a = b + c"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "table", "a | b\n1 | 2"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "table", "a | b\n1 | 2"),
        ("![Grain size](img/p.png)", "image", "Grain size"),
        ("[[File:p.png|thumb|Grain size]]", "image", "Grain size"),
    ],
)
def test_kinds_and_clean_text(tree, text, kind, clean):
    assert kind_of(tree, text) == (kind, clean)


@pytest.mark.parametrize("text", ["Samples with Ar3 < Ac1 were kept, 3 * 4 bars.", "- 107 -", "Items cost $ level 2 at set A & set B.", "The file plate_run_5 is kept.", "See [60], [95].", "COOLING PRACTICE", "σy = σ0 + k/√d", "Mill #5", ""])
def test_no_markup(text):
    assert len(markup.flatten(text)[0]) == 1


def test_unclosed_and_nested_markup_holds_together(tree):
    for text in ("<p>open <b>text", "\\begin{itemize}\n\\item a\n\\item b", "{| class=\"x\"\n| a || b", "<div><ul><li>a</li><li>b</li></ul></div>", "<" * 500, "$" * 99, "<p>" * 300 + "x"):
        nodes, feats, parents = markup.flatten(text)
        kinds = markup.decode(np.log(tree.prob(np.array(feats)) + 1e-9), parents)
        assert all(markup._ALLOWED[kinds[p], k] for k, p in zip(kinds[1:], parents[1:]))


def test_markup_table(spark):
    rows = [(1, "<h2>Head</h2>", "x"), (1, "<h2>Head</h2>", "x"), (2, None, "y"), (3, "", "z"), (4, PLAIN[0], None), (5, "**bold** words of a paragraph that goes on.", None)] + [(10 + i, t, "p") for i, t in enumerate(PLAIN)]
    df = spark.createDataFrame(rows, "block_id long, text string, block_kind string")
    assert {tuple(r) for r in markup.found(df).collect()} == {(1, "heading"), (5, "paragraph")}
    assert markup.found(df.limit(0)).collect() == []


# --- tokens and mixture -----------------------------------------------------------------------------------------------------------------


def test_walk_is_exact():
    tiktoken = pytest.importorskip("tiktoken")
    import regex

    ranks = tokens.load()
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdeéтионпр 12.,-\n") for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["a" * 500, " " * 300, "日本語 😀", "Schießpulver überdeckt"]
    p = regex.compile(tokens.PATTERN)
    pieces = sorted({x for t in texts for x in p.findall(t)})
    w = tokens.Walk(ranks)
    n = {x: w.tokens(x.encode()) for x in pieces}
    assert all(sum(n[x] for x in p.findall(t)) == len(enc.encode_ordinary(t)) for t in texts)


def test_counts_by_both_joins(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["Grain size of the strip, grain size.", "", None, "Размер зерна", "x" * 5000])]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    a = sorted(tuple(r) for r in tokens.counted(df, ["doc_id"]).collect())
    for few in (0, 3):
        monkeypatch.setattr(tokens, "BROADCAST", few)
        assert sorted(tuple(r) for r in tokens.counted(df, ["doc_id"]).collect()) == a
    assert len(a) == 5 and (1, 0) in a and (2, 0) in a


def test_budget_adds_up(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    b = tokens.budget(t("documents"), t("book_catalog"), t("chunks"), t("tokenized_chunks")).toPandas()
    whole = b[b.level == 3].iloc[0]
    assert whole.n_docs == t("documents").count() and whole.n_tokens == b[b.level == 0].n_tokens.sum() and whole.bge_estimate > 0
    empty = tokens.budget(t("documents").limit(0), t("book_catalog"), t("chunks").limit(0), t("tokenized_chunks")).toPandas()
    assert empty.n_tokens.fillna(0).sum() == 0


def test_mixture_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b", f"word {i} of the text") for i in range(2000)] + [(5000, None, "x"), (5001, "z", None)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("b", 0.4, 3), ("z", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert set(s) == {"a", "b"} and s["b"].most_copies <= 3 and s["a"].most_copies <= 1
    assert s["b"].rate == pytest.approx(3) and abs(s["a"].attained_share - 0.6) < 0.03
    m = mixture.mixture(docs, targets)
    assert m.filter("source = 'b'").count() == 600 and sorted(map(tuple, m.collect())) == sorted(map(tuple, mixture.mixture(docs, targets).collect()))
    assert mixture.mixture(docs.limit(0), targets).count() == 0


# --- consensus --------------------------------------------------------------------------------------------------------------------------


def test_consensus_trusts_judges_as_they_deserve(spark):
    rnd = random.Random(8)
    truth = [rnd.random() < 0.35 for _ in range(600)]
    acc = {"good": 0.93, "fair": 0.8, "coin": 0.5, "liar": 0.2, "fair2": 0.78}
    rows = []
    for i, t in enumerate(truth):
        f = {j: (t if rnd.random() < a else not t) for j, a in acc.items() if rnd.random() < 0.85}
        if "good" in f:
            f["good run2"] = not f["good"]
        rows.append((i, f if i % 97 else None, "2025-01-01"))
    df = spark.createDataFrame(rows + rows[:50], "item_id long, judge_flags map<string,boolean>, judged_at string")
    got = {r.item_id: r.verdict for r in consensus.verdicts(df).collect()}
    seen = [i for i in range(600) if i in got]
    assert len(got) == 600 - 7 and np.mean([got[i] == truth[i] for i in seen if "good" in (rows[i][1] or {})]) > 0.93
    r = {x.judge: x for x in consensus.reliability(df).collect()}
    assert set(r) == set(acc) and r["liar"].informedness < -0.3 and abs(r["coin"].informedness) < 0.2 and r["good"].sensitivity_low < r["good"].sensitivity < r["good"].sensitivity_high
    assert consensus.found(df.limit(0)).count() == 0 and consensus.reliability(df.limit(0)).count() == 0


def test_rounds_on_the_driver_equal_rounds_over_joins(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, {j: rnd.random() < (0.8 if (i % 3 == 0) == (j != "liar") else 0.25) for j in ("a", "b", "c", "liar") if rnd.random() < 0.9}, "x") for i in range(120)]
    df = spark.createDataFrame(rows, "item_id long, judge_flags map<string,boolean>, judged_at string")
    monkeypatch.setattr(consensus, "ROUNDS", 6)
    here = {r.item_id: r.p_true for r in consensus.verdicts(df).collect()}
    monkeypatch.setattr(consensus, "LOCAL", -1)
    there = {r.item_id: r.p_true for r in consensus.verdicts(df).collect()}
    assert here.keys() == there.keys() and max(abs(here[k] - there[k]) for k in here) < 1e-9


def test_mixture_of_a_given_size(spark):
    docs = spark.createDataFrame([(i, "s" if i % 4 else "t", "word " * 50) for i in range(400)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("s", 0.5, 3), ("t", 0.5, 2)], "source string, target_share double, max_repeats int")
    free = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert free["t"].rate == pytest.approx(2.0) and free["s"].attained_share == pytest.approx(0.5, abs=0.05)
    big = {r.source: r for r in mixture.shares(docs, targets, size=10 * free["s"].tokens_in).collect()}
    assert big["t"].rate == 2.0 and big["s"].rate == 3.0 and big["t"].attained_share < 0.3


def test_agreement_by_hand(spark):
    rows = [(1, {"a": True, "b": True}, "x"), (2, {"a": True, "b": False}, "x"), (3, {"a": False, "b": False}, "x"), (4, {"a": True}, "x"), (5, {"a": None, "b": True}, "x")]
    df = spark.createDataFrame(rows, "item_id long, judge_flags map<string,boolean>, judged_at string")
    r = consensus.agreement(df).first()
    assert (r.n_items, r.n_votes) == (3, 6) and r.alpha == pytest.approx(1 - (2 / 6) / (2 * 3 * 3 / 30), abs=1e-6)


# --- scanned text -----------------------------------------------------------------------------------------------------------------------


def test_parse_lines_breaks_and_pages():
    text = "The strip is cool-\ned in air and rec¬\nrystallized.\n\n- 12 -\n\nIn the pro-\nTHE ROLLING BULLETIN | 7\ncess, high- and low-carbon heats of Nb- teilig alloy"
    words, breaks, shorts = scan.parse(text)
    assert [(a, b) for a, b, *_ in breaks] == [("cool", "ed"), ("rec", "rystallized"), ("pro", "cess"), ("nb", "teilig")]
    assert [(s[1], s[2]) for s in shorts][:2] == [("", "12"), ("THE ROLLING BULLETIN", "7")] and "low-carbon" in words
    assert scan.parse(None) == ([], [], []) and scan.parse("") == ([], [], [])


def test_cost_takes_confusions_for_little():
    assert scan.cost("practlce", "practice")[0] == pytest.approx(0.3) and scan.cost("deforrnation", "deformation")[0] == pytest.approx(0.3)
    assert scan.cost("grain", "grains")[0] == 1 and scan.cost("a", "a") == (0.0, 0, 0)


def test_noise_is_found_and_mended(spark):
    rnd = random.Random(2)
    vocabulary = "temperature deformation transition austenite segregation condition precipitation recrystallization microstructure hardness reduction practice interval thickness behaviour direction".split()
    rows, want = [], set()
    for i in range(300):
        w = [rnd.choice(vocabulary) for _ in range(24)]
        text = " ".join(w[:12]) + "\n" + " ".join(w[12:]) + "."
        if i % 10 == 0:
            text = text.replace(w[3], w[3].replace("i", "1", 1), 1)
            if "1" in text:
                want.add((f"b_c{i}", "ocr", w[3]))
        if i % 10 == 1:
            k = w[5]
            text = text.replace(f"{w[4]} {k} ", f"{w[4]} {k[:4]}-\n{k[4:]} ", 1)
            want.add((f"b_c{i}", "hyphen", k))
        if i % 10 == 2:
            text = text.replace("\n", f"\nTHE MILL REVIEW | {i}\n", 1)
            want |= {(f"b_c{i}", "header", "THE MILL REVIEW"), (f"b_c{i}", "page_number", str(i))}
        rows.append((f"b_c{i}", "b", "Cooling", text))
    rows += [rows[0], ("b_x", None, None, None), ("b_y", "b", None, "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, book string, section string, text string")
    audit = spark.createDataFrame([], "audit_id long, chunk_id string, before_text string, after_text string")
    catalog = spark.createDataFrame([("b", "A Title")], "book string, title string")
    got = {(r.record_key, r.noise, r.fragment) for r in scan.noise(chunks, audit, catalog).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    fixed = {r.record_key: r.repaired for r in scan.repaired(chunks, audit, catalog).collect()}
    assert "THE MILL REVIEW" not in fixed["b_c2"] and "\n" not in fixed["b_c2"].strip() and fixed["b_x"] is None and "-" not in fixed["b_c1"]


def test_cost_of_cores_equals_the_whole():
    """Against the plain recursion over all splits."""
    from functools import lru_cache

    @lru_cache(None)
    def plain(a, b):
        if not a and not b:
            return 0.0
        best = 9e9
        for p in range(3):
            for q in range(3):
                if (p or q) and p <= len(a) and q <= len(b):
                    x, y = a[:p], b[:q]
                    c = 0.0 if x == y and p == 1 else 0.3 if (x, y) in scan._PAIRS else 1.0 if p <= 1 and q <= 1 else 9e9
                    if c < 9e9:
                        best = min(best, c + plain(a[p:], b[q:]))
        return best

    rnd = random.Random(3)
    for _ in range(400):
        w = "".join(rnd.choice("rnmclidoaei") for _ in range(rnd.randint(3, 9)))
        v = scan.misread(w, rnd) if rnd.random() < 0.7 else "".join(rnd.choice("rnmclidoaei") for _ in range(rnd.randint(3, 9)))
        assert scan.cost(v, w)[0] == pytest.approx(plain(v, w)), (v, w)


def test_working_form_knows_its_places():
    text = "Der Wert 10 mm² bei 5 m³, ½ und x¹: Gefu\u0308ge, ﬁne, \u200bna\u00a0ja"
    p = scan.Page(text)
    assert "".join(text[slice(*p.place(i, i + 1))] for i in range(len(p.text))).replace("\u200b", "") == text.replace("ﬁ", "ﬁﬁ").replace("\u200b", "")
    assert text[slice(*p.place(*next((a, b) for w, a, b in p.words if w == "gefüge")))] == "Gefu\u0308ge"


def test_text_outside_the_cases_is_unchanged():
    text = "Die Fläche ist 10 mm² bei 5 m³ und ½ x¹.\n\n| a | b |\n|---|---|\n12\n| c | d |\n\n```\n1000\nfoo- bar\n```\n\n1984\n\nEnde  mit   Lücken."
    assert scan.mend(text, {}, set(), set()) == text
    long = "A RUNNING HEADER OF A BOOK WITH A VERY LONG TITLE THAT IS FAR BEYOND ANY NINETY CHARACTERS THAT A LINE MAY HAVE"
    page = f"The strip is cool-\n{long}\n\n- 12 -\n\ned in air at 10 mm² and recrystalllzed there."
    head = next(s for s in scan.Page(page).shorts if s[1] == long)
    gone = {head[8], next(s[8] for s in scan.Page(page).shorts if s[2] == "12")}
    assert scan.mend(page, {"recrystalllzed": "recrystallized"}, {("cool", "ed", "-")}, gone) == "The strip is cooled in air at 10 mm² and recrystallized there."


def test_halves_far_apart_are_one_break():
    text = "The strip is cool-\n" + "\n".join(f"Fig. {i}. Rolls and stands" for i in range(30)) + "\ned in air."
    assert scan.parse(text)[1][0][:2] == ("cool", "ed")
    assert scan.parse("The strip is cool-\nAll is said here.\ned in air.")[1] == []


def test_numbers_in_columns_are_no_page_numbers(spark):
    text = "A sentence stands here and it goes on\n\n{}\n\nuntil it ends there, as any sentence does.\n\n1000\n2000\n3000\nA sentence closes the page."
    chunks = spark.createDataFrame([(f"b_c{i}", "b", None, text.format(17 + i)) for i in range(30)], "chunk_id string, book string, section string, text string")
    audit = spark.createDataFrame([], "audit_id long, chunk_id string, before_text string, after_text string")
    got = {(r.record_key, r.fragment) for r in scan.noise(chunks, audit, spark.createDataFrame([], "book string, title string")).filter("noise = 'page_number'").collect()}
    assert got == {(f"b_c{i}", str(17 + i)) for i in range(30)}


# --- pairs ------------------------------------------------------------------------------------------------------------------------------


def test_pair_defects(spark):
    rnd = random.Random(3)
    q = {"en": ("Why did plate {} fail in the test?", "Plate {} failed since the {} was too high, while the other plate held."), "ru": ("Почему лист {} расслоился при испытании?", "Лист {} расслоился, поскольку {} была слишком высокой, а другой лист уцелел."), "de": ("Warum riss das Blech {} in der Prüfung auf?", "Das Blech {} riss auf, denn die {} war zu hoch, während das andere Blech hielt.")}
    things = {"en": ["temperature", "reduction", "speed"], "ru": ["температура", "скорость", "деформация"], "de": ["Temperatur", "Abnahme", "Breite"]}
    rows, want = [], {}
    for i in range(600):
        g = rnd.choice(["en", "ru", "de"])
        code = f"AB-{i}"
        question, answer = q[g][0].format(code), q[g][1].format(code, rnd.choice(things[g]))
        d = ["empty", "truncated", "refusal", "copy", "wrong_language"][i // 12 % 5] if i % 12 == 0 else None
        if d == "empty":
            answer = rnd.choice(["", "N/A", "—"])
        elif d == "truncated":
            answer = answer[: int(len(answer) * 0.6)]
        elif d == "refusal":
            answer = rnd.choice(pairs.REFUSALS[g])
        elif d == "copy":
            answer = question
        elif d == "wrong_language":
            o = rnd.choice([x for x in q if x != g])
            answer = q[o][1].format(code, things[o][0])
        elif i % 7 == 0:
            answer = answer.rstrip(".")
        if d:
            want[f"q{i}"] = d
        rows.append((f"q{i}", question, answer, g))
    rows += [rows[0], ("qn", None, None, None)]
    want["qn"] = "empty"
    df = spark.createDataFrame(rows, "question_id string, question string, answer string, lang string")
    scores = spark.createDataFrame([], "question_id string, abstention boolean")
    got = {r.question_id: r.defect for r in pairs.found(df, scores).collect()}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right / len(want) > 0.9 and right / max(1, len(got)) > 0.9
    assert pairs.found(df.filter("question_id = 'qn'"), scores).count() == 1


# --- look-alikes ------------------------------------------------------------------------------------------------------------------------


def test_one_form(spark):
    rows = [
        ("a", "ｗｅａｋｅｎｅｄ by", "weakened by", True), ("b", "grаdе of striр", "grade of strip", True), ("c", "фeрритногo oкна", "ферритного окна", True), ("d", "zero​width\u00a0gap", "zerowidth gap", True),
        ("e", unicodedata.normalize("NFD", "Kühlung зёрен й"), "Kühlung зёрен й", True), ("f", "ﬁlm", "film", True), ("g", "FΟRMATIOΝ", "FORMATION", True), ("h", "Grade 09Г2ФБ at 900 °С, N/mm², 20 μm, σy = σ0", "Grade 09Г2ФБ at 900 °С, N/mm², 20 μm, σy = σ0", False),
        ("i", "Nb-сталь (аустенит) X70", "Nb-сталь (аустенит) X70", False), ("j", "", "", False), ("k", None, None, False), ("l", "x" * 30000 + " grаdе", "x" * 30000 + " grade", True), ("m", "a\u0323\u0302", "ậ", True), ("n", "a\u0302\u0323", "ậ", True),
    ]
    df = spark.createDataFrame([("chunk", k, t) for k, t, *_ in rows] + [("chunk", "a", rows[0][1])], "record_kind string, record_key string, text string")
    got = {r.record_key: (r.clean, r.variant) for r in lookalike.canonical(df).collect()}
    assert got == {k: (c, v) for k, _, c, v in rows}
    assert lookalike.canonical(df.limit(0)).count() == 0


# --- leaks ------------------------------------------------------------------------------------------------------------------------------


def test_search_equals_brute_force():
    rnd = random.Random(9)
    words = ["strip", "roll", "слиток", "wedge", "of", "the", "табло", "gauge", "cold", "under"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(12)]
    p = leak.Patterns(items)
    text = "".join(fold(w) for w in (" ".join(rnd.choice(words) for _ in range(400)) + " " + items[3][1] + " x " + items[7][1]).split())
    place, pattern = p.search(leak._codes(text))
    got = {(int(a), int(p.owner[b]), int(p.word[b])) for a, b in zip(place, pattern)}
    want = set()
    for k, (_, t) in enumerate(items):
        ws = [fold(w) for w in t.split()]
        whole = "".join(ws)
        at = 0
        for j, w in enumerate(ws):
            pat = whole[at : at + leak.M]
            if len(pat) == leak.M:
                i = text.find(pat)
                while i >= 0:
                    want.add((i, k, j))
                    i = text.find(pat, i + 1)
            at += len(w)
    assert got == want and want


def test_leaks_however_they_look(spark):
    rnd = random.Random(4)
    names = [f"{a}{b}" for a in ("ge", "wal", "tor", "mis", "bren", "kol") for b in ("ling", "ter", "mand", "sor", "wick", "dar", "num")]
    item = " ".join(rnd.choice(names) for _ in range(40))
    noise = " ".join(rnd.choice(names) for _ in range(60))
    w = item.split()
    rows = [(1, f"{noise} {item} {noise}"), (2, noise + " " + " ".join(w[:24]).upper() + "!"), (3, noise + " " + " ".join(w[:11])), (4, noise), (5, None), (6, ""), (7, item.replace("e", "е").replace(" ", "\n")), (8, f"{' '.join(w[:20])} <b>x</b> {' '.join(w[20:])[:5]}-\n{' '.join(w[20:])[5:]}"), (9, f"{noise} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(100, item), (101, None), (102, "short"), (100, item)], "item_id long, item_text string")
    assert {tuple(r) for r in leak.found(docs, items).collect()} == {(1, 100), (2, 100), (7, 100), (8, 100), (9, 100)}
    assert leak.found(docs.limit(0), items).count() == 0 and leak.found(docs, items.limit(0)).count() == 0


def test_blocks_of_items_short_items_and_shared_phrases(spark, monkeypatch):
    rnd = random.Random(9)
    phrase = "this phrase is shared by all of the items here "
    items = [(i, phrase + " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20))) for i in range(30)] + [(90, "rolling mills need good care")]
    docs = [(i, f"before {items[i][1]} after") for i in range(0, 30, 3)] + [(500, "we say rolling mills need good care always"), (501, phrase), (502, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, item_text string")
    want = {(i, i) for i in range(0, 30, 3)} | {(500, 90)}
    assert {tuple(r) for r in leak.found(d, t).collect()} == want
    monkeypatch.setattr(leak, "BLOCK_CHARS", 1500)
    monkeypatch.setattr(leak, "SLICE", 7)
    assert {tuple(r) for r in leak.found(d, t).collect()} == want and leak.blocks(t).count() > 1


def test_skeleton():
    assert plain("the<ref>AB-1</ref> [roll](x/y-1) con-\nfused &nbsp; {{cite|A}}").split() == ["the", "[roll", "confused"] or "confused" in plain("con-\nfused")
    assert fold("Grаdе") == fold("GRADE") == "grade" and fold("Kühlung") == fold(unicodedata.normalize("NFD", "KÜHLUNG"))


# --- toxic ------------------------------------------------------------------------------------------------------------------------------


def test_every_segment_of_a_sentence(spark):
    m = toxic.Model({"idiot": [9.0, -1, -1], "moron": [3.0, 8.0, -1], "vermin": [-1, 7.0, -1]}, [-1, -1, -1])
    keys = "idiot a b c d e f g h i vermin a a a a a a a a moron x y".split(" ")
    assert sorted(m.segments(keys), key=lambda x: x[2]) == [(9.0, 0, 0, 1), (7.0, 1, 10, 11), (8.0, 1, 19, 20)]
    assert m.segments(keys)[0] == m.segment(keys) and m.segments(["a", "b"]) == []
    rng = random.Random(5)
    words = {f"w{i}": [float(rng.randrange(-4, 4)) for _ in range(3)] for i in range(12)}
    m = toxic.Model(words, [-1, -1, -1])

    def by_hand(ks, at=0):
        sums = [(sum(words[k][c] for k in ks[i:j]), c, at + i, at + j) for c in range(3) for i in range(len(ks)) for j in range(i + 1, len(ks) + 1)]
        top = max((x[0] for x in sums), default=0)
        if top <= 0:
            return []
        score, c, i, j = min((x for x in sums if x[0] == top), key=lambda x: (x[1], x[3], x[2]))
        i = max(x[2] for x in sums if x[0] == top and x[1] == c and x[3] == j)
        return [(score, c, i, j), *by_hand(ks[: i - at], at), *by_hand(ks[j - at :], j)]

    for _ in range(60):
        ks = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 14))]
        assert sorted(m.segments(ks)) == sorted(by_hand(ks))
    two = toxic.Model({"idiot": [9.0, -1, -1], "vermin": [-1, 7.0, -1]}, [-1, -1, -1])
    rows = toxic.segments(spark.createDataFrame([(1, "0 " + " ".join(["idiot", *"abcdefghij", "vermin"]))], "doc_id long, keys string"), two).collect()
    assert {(r.cls, r.score, r.n) for r in rows} == {(0, 9.0, 1), (1, 7.0, 0), (-1, 0.0, 0)}



def test_masking_is_taken_back():
    for a, b in (("1di0t", "idiot"), ("b@$t@rd", "bastard"), ("scumbaaaag", "scumbag"), ("тупiцa", "тупица"), ("крррретин", "кретин"), ("идi0т", "идиот")):
        assert toxic.key(a) == toxic.key(b)
    assert toxic.sentences("you braindead m o r o n today.")[0] == ["you", "braindead", "moron", "today"]
    assert toxic.Model({"moron": [3.0, 0, 0]}, [-1, -1, -1]).row(toxic.sentences("a m o r o n")[0][0]) == [3.0, 0, 0]
    m = toxic.Model({"idiot": [3.0, 0, 0]}, [-1, -1, -1])
    assert m.row("idi*t") == [3.0, 0, 0] and toxic.sentences(None) == []


def test_best_segment_against_brute_force():
    rnd = random.Random(1)
    scores = {f"w{i}": [rnd.uniform(-2, 2) for _ in toxic.CATEGORIES] for i in range(10)}
    m = toxic.Model(scores, [-1.0, -1.0, -1.0])
    for _ in range(50):
        keys = [f"w{rnd.randint(0, 14)}" for _ in range(12)]
        best = max(sum(m.row(k)[c] for k in keys[i:j]) for c in range(3) for i in range(12) for j in range(i + 1, 13))
        assert m.segment(keys)[0] == pytest.approx(max(best, 0.0) if any(k in scores for k in keys) else 0.0)
    texts = ["\n".join("0 " + " ".join(f"w{rnd.randint(0, 14)}" for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 5))) for _ in range(40)] + ["", "1 w1"]
    x = m.maxima(texts)
    lines = [(d, k) for d, t in enumerate(texts) for _, k in toxic._lines(t)]
    assert x.doc.tolist() == [d for d, _ in lines] and x.words == [k for _, k in lines]
    assert x.best.max(1) == pytest.approx([m.segment(k)[0] for _, k in lines], abs=1e-4)


def test_scale_of_maxima():
    # Two scores, +1 with share p and -1 with share q: exp(x) = q / p.
    assert toxic.scale_of([1.0], [249_999.5], -1.0, 1_000_000.0) == pytest.approx(1 / np.log(3), rel=1e-3)


def test_all_passages_and_labels_teach(spark):
    # Beyond 100 000 passages and 20 000 labelled documents, every one counts, and once: also a word that only one of them has.
    n = 120_000
    lines = spark.range(n).select(F.lit(1).alias("cls"), F.concat(F.lit("2 vermin f*ul "), F.when(F.col("id") % 3_000 == 0, F.concat(F.lit("rare"), "id")).otherwise("often")).alias("line"))
    rare = {f"rare{i}": 1.0 for i in range(0, n, 3_000)}
    counts = toxic.taught(lines)
    assert {(r.cls, r.speech) for r in counts.collect()} == {(1, 2)}
    assert {r.token: r.n for r in counts.collect()} == rare | {"vermin": float(n), "often": float(n - len(rare))}
    corpus = counts.select("speech", "token", (F.col("n") * 2).alias("corpus"))
    per = toxic.words(counts, corpus)
    assert sorted(per["token"]) == sorted([*rare, "vermin", "often"]) and (per["corpus"] == 2 * per["n1"]).all() and not per[["n0", "n2"]].any().any()
    assert set(rare) <= set(toxic.weighed(per, [0.0, 0.0, 1e8]).scores)
    ids = spark.range(25_000).select(F.col("id").alias("doc_id"))
    labels = ids.select("doc_id", F.lit(1).alias("toxic"), F.lit("hate").alias("category"), F.lit("r").alias("reviewer"))
    assert toxic.labelled(ids.withColumn("text", F.lit("x")), labels).filter("cls = 1").count() == 25_000


def test_masked_words_against_brute_force():
    rnd = random.Random(3)
    scores = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 6))): [rnd.uniform(-2, 4) for _ in toxic.CATEGORIES] for _ in range(60)}
    m = toxic.Model(scores, [-1.0, -1.0, -1.0])
    strong = [w for w, s in scores.items() if max(s) > 1 and len(w) >= 4]
    masked = {x for w in strong for i in range(len(w)) for x in (w[:i] + "*" + w[i + 1 :], w[:i] + "*" + w[i:])}
    for t in sorted(masked) + ["zz*zz", "a*b*c", "*", "abc*"]:
        near = [w for w in strong if any(t in (w[:i] + "*" + w[i + 1 :], w[:i] + "*" + w[i:]) for i in range(len(w)))]
        assert m.unmasked(t) == (max(near, key=lambda w: max(scores[w])) if near else t)


def test_toxic_documents(spark):
    rnd = random.Random(6)
    base = ["The strip is cooled on the table.", "Rolling force follows the reduction.", "Grain size depends on the finishing pass.", "The slab leaves the furnace at night."]
    bad = {"abuse": "You stupid idiot, shut up, you worthless moron.", "hate": "All of them are vermin and subhuman parasites, wiped out they must be.", "sexual": "Horny naked sluts send nudes on webcam, hardcore porn sex."}
    rows, labels, want = [], [], set()
    for i in range(400):
        s = [rnd.choice(base) for _ in range(5)]
        if i % 25 == 0:
            c = list(bad)[i // 25 % 3]
            s.insert(2, bad[c])
            want.add((i, c))
            if i % 50 == 0:
                labels.append((i, 1, c, "r1"))
        elif i % 9 == 0:
            labels.append((i, 0, None, "r1"))
        rows.append((i, " ".join(s), "a" if i % 2 else None))
    docs = spark.createDataFrame(rows + [(900, None, "a"), (901, "", "b")], "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels + labels[:3] + [(99999, 1, "hate", "r2")], "doc_id long, toxic int, category string, reviewer string")
    assert {tuple(r) for r in toxic.found(docs, lab).collect()} == want
    r = {x.source: x for x in toxic.rates(docs, lab).collect()}
    assert sum(x.n_docs for x in r.values()) == 402 and sum(x.n_toxic for x in r.values()) == len(want)
    assert toxic.found(docs.limit(0), lab).count() == 0
