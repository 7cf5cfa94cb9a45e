"""Defective question and answer pairs: a multi-label linear classifier on hashed n-grams and pair features.

Trained on a bounded sample of pairs (SAMPLE rows): answers as they are, and answers emptied, cut off, replaced by the question, by a refusal or by an
answer in another language. Answers of the sample that the first fit finds defective are left out of the second; thresholds
are set on held-out pairs. The label with the largest margin over its threshold is the defect; none over it, no defect. How often answers end in a word
is counted over all answers and joined to each pair.

Defined results: a null or blank answer is empty; a null question counts as blank; repeated rows count once; differing rows of one question are judged each, and the
defect of the largest margin is that of the question; rows of a null id stay apart. Texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.session import cut, fine

LABELS = ["empty", "truncated", "refusal", "copy", "wrong_language"]
#: Pairs that the classifier is fitted on, at most.
SAMPLE = 4000
BITS = 16
LANGS = ["en", "ru", "de"]

PLACEHOLDERS = {"", "n/a", "na", "n.a", "null", "none", "nan", "nil", "tbd", "todo", "tba", "k.a", "keine angabe", "нет", "нет данных", "н/д", "undefined", "empty", "no answer", "answer", "xxx", "test", "missing", "unknown", "placeholder"}
REFUSALS = {
    "en": ["I cannot answer this question.", "Sorry, I can't help with that.", "I do not know.", "The context does not contain the answer.", "There is not enough information to answer this.", "As an AI model I am unable to answer.", "Unfortunately I cannot say anything about this.", "I must decline to answer.", "No information is given in the sources.", "It is not possible to answer on the basis of the given data.", "I'm sorry, but I can't answer that.", "The sources do not mention this, so I cannot answer.", "Not stated in the text."],
    "ru": ["Я не могу ответить на этот вопрос.", "К сожалению, не могу помочь с этим.", "Не знаю.", "В контексте нет ответа на этот вопрос.", "Недостаточно сведений для ответа.", "Как языковая модель, я не могу ответить.", "Ответить по этим данным невозможно.", "Извините, помочь с этим вопросом не могу.", "В источниках нет сведений об этом.", "Ответ дать нельзя.", "По имеющимся данным ответить невозможно."],
    "de": ["Ich kann diese Frage nicht beantworten.", "Leider kann ich dabei nicht helfen.", "Das weiß ich nicht.", "Der Kontext enthält dazu keine Angaben.", "Es liegen nicht genügend Informationen vor.", "Als Sprachmodell kann ich dazu nichts sagen.", "Dazu kann keine Auskunft gegeben werden.", "Eine Antwort ist nicht möglich.", "Es tut mir leid, das kann ich nicht beantworten.", "In den Quellen steht dazu nichts."],
}
LEADS = {"en": ["You ask: ", "Question: ", "The question is: ", "You asked "], "ru": ["Вы спрашиваете: ", "Вопрос: ", "Вопрос был: "], "de": ["Sie fragen: ", "Frage: ", "Die Frage lautet: "]}
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CODE = re.compile(r"\b[A-Za-z]{1,3}-\d+\b|\d+")


@lru_cache(1 << 18)
def _h(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << BITS) - 1)


#: Control and format characters but line feed and tab.
_HIDDEN = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]")


@lru_cache(1 << 14)
def norm(s: str | None) -> str:
    s = s or ""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    return " ".join(_HIDDEN.sub("", s).split())


def words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


class Language:
    """Naive Bayes over words and character trigrams; fitted on the questions of the sample with their lang column."""

    def __init__(self, texts: list[str], langs: list[str | None]):
        self.w = np.zeros((1 << BITS, len(LANGS)))
        for t, g in zip(texts, langs):
            if g in LANGS:
                for i in self.grams(t):
                    self.w[i, LANGS.index(g)] += 1
        self.w = np.log(self.w + 0.05) - np.log(self.w.sum(0) + 0.05 * len(self.w))
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"w": self.w, "_known": {}}

    @staticmethod
    def grams(t: str) -> list[int]:
        t = _CODE.sub("", t.lower())
        t = re.sub(r"[«\"“][^»\"”]{1,40}[»\"”]", "", t)
        return [_h("w" + w) for w in words(t)] + [_h("c" + p[i : i + 3]) for w in words(t) for p in [f" {w} "] for i in range(len(p) - 2)]

    def probs(self, t: str) -> np.ndarray:
        if (p := self._known.get(t)) is None:
            g = self.grams(t)
            s = self.w[g].sum(0) if g else np.zeros(len(LANGS))
            e = np.exp(s - s.max())
            p = e / e.sum()
            if len(self._known) > 1 << 14:
                self._known.clear()
            self._known[t] = p
        return p


def end_of(text: Column) -> Column:
    """The last word of an answer, numbers as 0."""
    return F.regexp_extract(F.regexp_replace(F.lower(text), r"[0-9]+", "0"), r"(\p{L}+|0)[^\p{L}0]*$", 1)


def _end(a: str) -> str:
    """end_of() of a text in Python."""
    m = re.search(r"([^\W\d_]+|0)[^\w]*$", re.sub(r"\d+", "0", a.lower()))
    return m[1] if m else ""


def features(q: str | None, a: str | None, lang: Language, ends: float) -> dict[int, float]:
    """Sparse features of a pair: hashed n-grams of the answer, of its end, of its end beside the question's head, and pair features; ends: how many of 10 000 closed answers end in its last word."""
    q, a = norm(q), norm(a)
    out: dict[int, float] = {}
    add = lambda k, v=1.0: out.__setitem__(_h(k), v)
    qw, aw = words(q), words(_CODE.sub("0", a))
    bare = a.lower().strip(" .!…-–—?*_/\\()[]\"'")
    add("bias")
    if bare in PLACEHOLDERS or not re.search(r"\w", bare):
        add("blank", 12.0)
    for n in (1, 2, 3):
        for i in range(len(aw) - n + 1):
            add(f"{n}:" + " ".join(aw[i : i + n]), 0.5)
    stem = a.rstrip(" .!?»\"”)…")
    tail = words(_CODE.sub("0", stem))
    head = " ".join(words(_CODE.sub("0", q))[:2])
    for n in (1, 2, 3):
        add(f"t{n}:" + " ".join(tail[-n:]))
        add(f"ht{n}:{head}|" + " ".join(tail[-n:]))
    # Shares, not counts, so that the feature means the same in a corpus of any size.
    add(f"end{min(max(int(np.log2(ends + 1e-9)) + 4, 0), 14)}", 3.0 if len(tail) > 3 else 0.5)
    for n in (2, 3, 4):
        add(f"e{n}:" + re.sub(r"\d", "0", stem[-n:]))
    add("ellipsis" if re.search(r"(?:\.\.\.|…)$", a) else "dot" if re.search(r"[.!?»\"”)]$", a) else "nodot", 2.0)
    add("cut" if re.search(r"[,;:(-]$", a) else "nocut")
    add(f"len{min(len(aw), 40) // 4}|{head}")
    qa, aa = set(qw), words(a)
    inside, covered = sum(w in qa for w in aa) / max(len(aa), 1), len(qa & set(aa)) / max(len(qa), 1)
    add("inside", 4 * inside)
    add("covered", 4 * covered)
    for k in (0.6, 0.8, 0.95):
        add(f"both{k}", 5.0 * (min(inside, covered) >= k and len(aa) > 2))
    if covered >= 0.95 and len(qa) > 2:
        # The whole question is in the answer: what is there besides?
        add(f"besides{min(max(len(aa) - len(qw), 0), 8)}", 5.0)
    pq, pa = lang.probs(q), lang.probs(a)
    same = float(pq @ pa) if aa and re.search(r"[^\W\d_]", _CODE.sub("", a)) else 1.0
    add("other", 8.0 * (1 - same))
    add("same", 4.0 * same)
    return out


def closeness(q: str | None, a: str | None, lang: Language) -> tuple[float, float]:
    """(share of words that question and answer have in common, probability of one language)."""
    qw, aw = set(words(norm(q))), words(norm(a))
    share = min(sum(w in qw for w in aw) / max(len(aw), 1), len(qw & set(aw)) / max(len(qw), 1))
    return share, float(lang.probs(norm(q)) @ lang.probs(norm(a)))


class Linear:
    """One logistic unit a label over the hashed features, AdaGrad over small batches."""

    def __init__(self, labels: int):
        self.w = np.zeros((1 << BITS, labels), np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 24, rate: float = 0.2, l2: float = 1e-5, batch: int = 24, seed: int = 5) -> "Linear":
        g2, rnd = np.full_like(self.w, 1e-2), np.random.default_rng(seed)
        order, batches = rnd.permutation(len(rows)), []
        # Batches are made once, with their entries also in the order of the slots; epochs differ in the order of the batches.
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            k, v, row = _stacked([rows[i] for i in part])
            by = np.argsort(k, kind="stable")
            slots, first = np.unique(k[by], return_index=True)
            batches.append((k, v[:, None], row, len(part), by, slots, first, y[part]))
        for _ in range(epochs):
            for i in rnd.permutation(len(batches)):
                k, v, row, n, by, slots, first, want = batches[i]
                p = 1 / (1 + np.exp(-np.clip(_margins(self.w, k, v[:, 0], row, n), -30, 30)))
                g = np.add.reduceat((v * (p - want)[row])[by], first, axis=0) + l2 * self.w[slots]
                g2[slots] += g * g
                self.w[slots] -= rate * g / np.sqrt(g2[slots])
        return self

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, self.w.shape[1]))
        return 1 / (1 + np.exp(-np.clip(_margins(self.w, *_stacked(rows), len(rows)), -30, 30)))


def _stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, row of each) of sparse rows, none of which is empty."""
    return np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])


def _margins(w: np.ndarray, k: np.ndarray, v: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    starts = np.searchsorted(row, np.arange(n))
    return np.add.reduceat(v[:, None] * w[k], starts, axis=0)


def _row(f: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(f, np.int64, len(f)), np.fromiter(f.values(), np.float64, len(f))


def spoiled(q: str, a: str, g: str, label: str, others: dict[str, list[str]], refusals: dict[str, list[str]], rnd: np.random.Generator) -> str | None:
    """An answer with a defect made from a sound pair; None where this pair gives none."""
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    if label == "empty":
        return pick(["", " ", "-", "—", ".", "…", "\n", "​", "?", *PLACEHOLDERS])
    if label == "truncated":
        if len(a.split()) < 6:
            return None
        cut = a[: int(len(a) * rnd.uniform(0.25, 0.97))].rstrip()
        return None if len(a.rstrip(" .")) - len(cut) < 3 else cut + pick(["", "", "", "", "…", "...", " -", " (", ","]) if rnd.random() < 0.2 else cut
    if label == "refusal":
        r = pick(refusals[g])
        return pick([r, r, r.lower().rstrip("."), f"{pick(refusals[g])} {r}"])
    if label == "copy":
        return pick([q, q, q.rstrip("?") + ".", q.lower(), f"{q} {q}", pick(LEADS[g]) + q[0].lower() + q[1:], pick(LEADS[g]) + q, q.rstrip("?")]) if q else None
    rest = [x for x in LANGS if x != g and others[x]]
    return pick(others[pick(rest)]) if rest else None


def _made(texts: list[tuple[str | None, str | None, float]], lang: Language) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_row(features(q, a, lang, e)) for q, a, e in texts]


def train(pairs: list[tuple[str | None, str | None, str | None]], ends: dict[str, float], refused: set[int] = frozenset(), featurize: Callable = _made, seed: int = 11):
    """(language model, linear model, thresholds) from (question, answer, lang) rows; ends: share of answers by their last word; refused: rows that judges found to abstain, held out of the sound answers; featurize: sparse rows of (question, answer, ends)."""
    rnd = np.random.default_rng(seed)
    lang = Language([f"{norm(q)}" for q, _, _ in pairs], [g for _, _, g in pairs])
    guess = [LANGS[int(lang.probs(norm(q)).argmax())] for q, _, _ in pairs]
    # Short answers teach the language of their question only where most answers of that question language share their words.
    lang = Language([norm(q) for q, _, _ in pairs] + [norm(a) for _, a, _ in pairs], guess + guess)
    plain = lambda a: " ".join(words(_CODE.sub("", norm(a))))
    # What judges mostly call an abstention, by wording, joins the refusals.
    said: dict[str, list[int]] = {}
    for i, (_, a, _) in enumerate(pairs):
        said.setdefault(plain(a), []).append(i in refused)
    abstains = {t for t, v in said.items() if len(t.split()) > 1 and t.replace(" ", "/") not in PLACEHOLDERS and t not in PLACEHOLDERS and sum(v) >= 2 and sum(v) > len(v) / 2}
    refusals = {g: [*REFUSALS[g], *sorted({norm(a) for i, (_, a, _) in enumerate(pairs) if guess[i] == g and plain(a) in abstains})] for g in LANGS}
    sound = [i for i, (q, a, _) in enumerate(pairs) if norm(a) and i not in refused and plain(a) not in abstains]
    near = {i: closeness(pairs[i][0], pairs[i][1], lang) for i in sound}
    sound = [i for i in sound if near[i][0] < 0.8 and near[i][1] > 0.5] or sound

    # What is made of each sound row, once: itself, itself without its full stop, and its spoiled forms.
    others = {g: [pairs[i][1] for i in sound if guess[i] == g] for g in LANGS}
    texts, y, of = [], [], []

    def add(i: int, q: str | None, a: str | None, label: int) -> None:
        texts.append((q, a, ends.get(_end(a or ""), 0.0)))
        y.append(np.eye(len(LABELS))[label] if label >= 0 else np.zeros(len(LABELS)))
        of.append(i)

    for i in sound:
        q, a = pairs[i][0] or "", pairs[i][1] or ""
        add(i, q, a, -1)
        if rnd.random() < 0.3:
            add(i, q, a.rstrip(" ."), -1)
        for k, label in enumerate(LABELS):
            for _ in range(2 if label == "truncated" else 1):
                if rnd.random() < (1.0 if label == "truncated" else 0.35) and (s := spoiled(q, a, guess[i], label, others, refusals, rnd)) is not None:
                    add(i, q, s, k)
    # A text that is written as a defect here is no sound answer, wherever it stands.
    shape = lambda a: norm(a).lower().strip(" .!…")
    written = {shape(a) for (_, a, _), k in zip(texts, y) if k[0] or k[2]}
    fair = [n for n, ((_, a, _), k) in enumerate(zip(texts, y)) if k.any() or shape(a) not in written]
    texts, y, of = [texts[n] for n in fair], [y[n] for n in fair], [of[n] for n in fair]
    rows, y, of = featurize(texts, lang), np.array(y).reshape(-1, len(LABELS)), np.array(of, int)
    # The first row of each pair that is the pair itself; pairs that are no sound ones have none.
    first = np.concatenate([[True], of[1:] != of[:-1]]) & ~y.any(1) if len(of) else np.zeros(0, bool)

    def fitted(base: np.ndarray):
        """Model and thresholds from what is made of the rows in base."""
        held = rnd.random(len(base)) < 0.2
        model, cut = Linear(len(LABELS)).fit([rows[n] for n in base[~held]], y[base[~held]]), np.full(len(LABELS), 0.5)
        p, t = model.score([rows[n] for n in base[held]]), y[base[held]]
        for k in range(len(LABELS)):
            cut[k] = max((2 * ((p[:, k] >= c) & (t[:, k] == 1)).sum() / max(1, (p[:, k] >= c).sum() + (t[:, k] == 1).sum()), -abs(c - 0.5), c) for c in np.linspace(0.2, 0.9, 15))[2]
        return model, cut

    # Each half of the rows is cleaned by a model of the other half, so that no row vouches for itself.
    half = np.unique(of, return_inverse=True)[1] % 2
    keep = np.zeros(len(of), bool)
    for h in (0, 1):
        model, cut = fitted(np.flatnonzero(half != h))
        mine = np.flatnonzero(first & (half == h))
        s = model.score([rows[n] for n in mine])
        good = set(of[mine[~(s >= cut).any(1)]].tolist())
        keep |= (half == h) & np.isin(of, list(good))
    model, cut = fitted(np.flatnonzero(keep) if keep.any() else np.arange(len(of)))
    return lang, model, cut


def sample(questions: DataFrame, scores: DataFrame) -> tuple[list[tuple[str | None, str | None, str | None]], set[int]]:
    """At most SAMPLE distinct pairs, the first by hash among those that a hash draws (some SAMPLE * 20 of a table of any size), and which of them most judges found abstaining."""
    every = max(1, questions.count() // (SAMPLE * 20))
    questions = questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(every)) == 0)
    abstained = scores.groupBy("question_id").agg(F.avg(F.col("abstention").cast("double")).alias("share"))
    picked = questions.select("question_id", "question", "answer", "lang").distinct().orderBy(F.xxhash64("question_id"), "question_id", "answer").limit(SAMPLE)
    rows = picked.join(abstained, "question_id", "left").collect()
    rows.sort(key=lambda r: (r.question_id or "", r.answer or ""))
    return [(r.question, r.answer, r.lang) for r in rows], {i for i, r in enumerate(rows) if (r.share or 0) > 0.5}


def endings(questions: DataFrame) -> DataFrame:
    """(end, ends): how many of 10 000 answers, of all that close with a full stop, end in a word."""
    closed = questions.filter(F.col("answer").rlike(r"[^.][.!?][\"»”)]*\s*$"))
    n = cut(closed.select("question_id", "answer").distinct().groupBy(end_of(F.col("answer")).alias("end")).agg(F.count("*").alias("n")))
    return n.select("end", (F.col("n") * 10_000.0 / float(n.agg(F.sum("n")).first()[0] or 1)).alias("ends"))


def scored(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """(question_id, defect or null, margin, one probability a label) of each distinct pair of a question."""
    ends = endings(questions)
    rows, refused = sample(questions, scores)
    # Only the words of the sample can end an answer made of it.
    need = {w for _, a, _ in rows for w in re.findall(r"[^\W\d_]+", (a or "").lower())} | {"0", ""}
    need |= {w[:k] for w in need for k in range(1, len(w))}
    words_ = questions.sparkSession.createDataFrame([(w,) for w in sorted(need)], "end string")
    known = {r.end: r.ends for r in ends.join(words_, "end", "left_semi").collect()}

    def featurize(texts: list[tuple[str | None, str | None, float]], lang: Language) -> list[tuple[np.ndarray, np.ndarray]]:
        """_made() on the executors; the texts are made of the sample, a dozen or so for each of its rows."""
        spark = questions.sparkSession
        model = spark.sparkContext.broadcast(lang)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = _made(list(zip(b.q, b.a, b.e)), model.value)
                yield pd.DataFrame({"n": b.n, "k": [k for k, _ in made], "v": [v for _, v in made]})

        table = pd.DataFrame([(n, *t) for n, t in enumerate(texts)], columns=["n", "q", "a", "e"])
        got = fine(spark.createDataFrame(table, "n long, q string, a string, e double")).mapInPandas(run, "n long, k array<long>, v array<double>").toPandas().sort_values("n")
        return list(zip(got.k, got.v))

    held = questions.sparkSession.sparkContext.broadcast(train(rows, known, refused, featurize))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, model, cut = held.value
        for b in batches:
            p = model.score([_row(features(q, a, lang, 0.0 if e is None or e != e else e)) for q, a, e in zip(b.question, b.answer, b.ends)])
            blank = np.array([not norm(a) for a in b.answer], bool)
            margin = np.log(p + 1e-9) - np.log(cut)
            best = margin.argmax(1) if len(b) else np.zeros(0, int)
            defect = [None if not x and margin[i, j] < 0 else LABELS[0 if x else j] for i, (x, j) in enumerate(zip(blank, best))]
            yield pd.DataFrame({"question_id": b.question_id, "defect": pd.Series(defect, dtype=object), "margin": np.where(blank, 99.0, margin[np.arange(len(b)), best]), **{f"p_{k}": p[:, i] for i, k in enumerate(LABELS)}})

    pairs = questions.select("question_id", "question", "answer").distinct().withColumn("end", end_of(F.col("answer")))
    pairs = fine(pairs.join(ends, "end", "left").select("question_id", "question", "answer", "ends"))
    return pairs.mapInPandas(run, "question_id string, defect string, margin double, " + ", ".join(f"p_{k} double" for k in LABELS))


def found(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """(question_id, defect) of each defective pair."""
    bad = scored(questions, scores).filter("defect is not null")
    apart = F.when(F.col("question_id").isNull(), F.col("defect"))
    return bad.groupBy("question_id", apart.alias("apart")).agg(F.max_by("defect", F.struct("margin", "defect")).alias("defect")).drop("apart")
