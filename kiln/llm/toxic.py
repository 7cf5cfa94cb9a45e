"""Abusive, hateful or sexual passages: maximum-scoring segments over token log-odds.

Tokens are taken back from masking (spaced letters, digits and signs for letters, repeated letters, look-alikes, asterisks). Log-odds of a token for
a category against the corpus use a Dirichlet prior in proportion to the corpus; first from labelled documents,
then, ROUNDS times, from the passages that the model before finds. One pass over the tokens of each sentence finds
its maximum-scoring segment; a Gumbel law turns a segment's score into a p-value, and segments below ALPHA are significant. Its scale comes from the
scores of the tokens and their shares in the corpus without the passages (the root of the sum of share times exp(score / scale) = 1), its location from
the sentence maxima of all documents. A segment counts for its category of the highest score.

All labelled documents and all passages teach a model; executors count their words, the driver holds a row a distinct word. Defined results:
null and empty texts score 0; documents with a null id have no row; labels of documents that are not there are ignored; repeated label rows count once; a document with labels that
contradict each other takes their majority.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.lookalike import CYRILLIC_LATIN, GREEK_LATIN, LATIN_CYRILLIC
from kiln.llm.skeleton import plain
from kiln.session import cut, fine

CATEGORIES = ["abuse", "hate", "sexual"]
#: How often a model teaches the next.
ROUNDS = 2
#: Weight of the Dirichlet prior in tokens.
PRIOR = 300.0
#: Standard errors that a token's log-odds must lie above 0 to count for a category.
SURE = 2.5
#: p-value of a sentence below which its segment is significant. Words of a sentence are no independent draws, as the law takes them for, so it is small.
ALPHA = 1e-8
#: Score from which a segment's words teach the next model.
FIRM = 12.0
#: Largest score of one token; no word alone decides a long passage.
TOP = 4.0

_SPACED = re.compile(r"(?<![\w*@$])(?:[^\W\d_] ){2,}[^\W\d_](?![\w*@$])")
_TOKEN = re.compile(r"[\w@$*!]*[^\W\d_][\w@$*!]*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"')»”]+|\n+")
_REPEAT = re.compile(r"(.)\1+")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_LEET_CYR = str.maketrans({"0": "о", "1": "и", "3": "з", "4": "ч", "@": "а", "$": "с", "!": "и", "i": "и", "u": "и"} | {k.lower(): v.lower() for k, v in LATIN_CYRILLIC.items()})
_TO_LAT = str.maketrans({k.lower(): v.lower() for k, v in (CYRILLIC_LATIN | GREEK_LATIN).items()})
_CYR = re.compile("[а-яё]")
_LAT = re.compile("[a-zäöüß]")


@lru_cache(300_000)
def key(token: str) -> str:
    """The word that a token stands for: lower case, one script, letters for signs and digits, repeats single; '*' stays."""
    t = token.lower().strip("!*")
    if not t.isascii() or not t.isalpha():
        if len(_CYR.findall(t)) >= len(_LAT.findall(t)) and _CYR.search(t):
            t = t.translate(_LEET_CYR)
        else:
            t = t.translate(_TO_LAT)
            t = t.translate(_LEET) if sum(c.isalpha() for c in t) >= 2 else t
    return _REPEAT.sub(r"\1", t)


def sentences(text: str | None) -> list[list[str]]:
    """Keys of each sentence. A passage in spaced letters is one word."""
    if not text:
        return []
    t = plain(text)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    t = _SPACED.sub(lambda m: m[0].replace(" ", ""), t)
    return [k for s in _SENTENCE.split(t) if (k := [key(x) for x in _TOKEN.findall(s)])]


_GERMAN = {"der", "die", "das", "den", "dem", "und", "ist", "du", "ein", "eine", "für", "im", "in", "mit", "wie", "ohne", "wurde", "gilt", "nur", "dich", "ich", "kein", "sind", "deine", "mir", "so", "doch", "wer"}
_ENGLISH = {"the", "of", "is", "in", "and", "by", "a", "you", "are", "to", "for", "was", "with", "i", "your", "this", "be", "that", "on", "at", "no", "me", "her", "she", "he", "as"}


@lru_cache(300_000)
def _leaning(k: str) -> int:
    """What a word says of its sentence: a Cyrillic letter in front counts 10^9, a letter with dots 10^6, German and English function words 1 and -1."""
    return 1_000_000_000 * bool(_CYR.match(k)) + 1_000_000 * ("ü" in k or "ö" in k or "ä" in k) + (k in _GERMAN) - (k in _ENGLISH)


def speech(keys: list[str]) -> int:
    """Language group of a sentence by script and function words: 0 Latin, 1 Cyrillic, 2 German."""
    total = sum(map(_leaning, keys))
    if round(total / 1_000_000_000) * 2 > len(keys):
        return 1
    return 2 if 0 < total % 1_000_000_000 < 900_000_000 else 0


class Model:
    """Token scores of each category; a token that is not listed scores the drift of its category."""

    def __init__(self, scores: dict[str, list[float]], drift: list[float]):
        self.scores, self.drift, self.scale = scores, drift, 1.0
        self.letters = sorted({x for w, s in scores.items() if max(s) > 1 and len(w) >= 4 for x in w})

    def unmasked(self, token: str) -> str:
        """The word of the highest score, of equal ones the first by name, that has a letter in the place of the '*' or before which or within which it was put; the token if there is none."""
        before, _, after = token.partition("*")
        near = [before + after] * bool(after) + [before + x + after for x in self.letters]
        near = [w for w in near if len(w) >= 4 and w in self.scores and max(self.scores[w]) > 1]
        return min(near, key=lambda w: (-max(self.scores[w]), w), default=token)

    def row(self, token: str) -> list[float]:
        if "*" in token:
            token = self.unmasked(token)
        if token not in self.scores and len(token) > 4 and token[0] in "aiаияв":
            # Spaced letters after a word of one letter: "a m o r o n".
            token = token[1:]
        return self.scores.get(token, self.drift)

    def segment(self, keys: list[str]) -> tuple[float, int, int, int]:
        """(score, category, start, end) of the best segment of a sentence over all categories."""
        rows = self.rows(keys)
        return self._best(rows, 0, len(rows))

    def segments(self, keys: list[str]) -> list[tuple[float, int, int, int]]:
        """The best segment, then those of what is left of it and right of it, and so on: the maximal scoring segments, where categories overlap of the one that scores more."""
        rows, out = self.rows(keys), []
        parts = [(0, len(rows))]
        while parts:
            i, j = parts.pop()
            best = self._best(rows, i, j)
            if best[0] > 0:
                out.append(best)
                parts += [(i, best[2]), (best[3], j)]
        return out

    def maxima(self, texts: list[str]) -> Maxima:
        """The best score of each sentence of a batch of keyed documents, all sentences at once: within a sentence the greatest rise of the running sum above its least value before."""
        index, sentences_, doc = _Index(self), [], []
        for d, t in enumerate(texts):
            if t:
                lines = t.split("\n")
                sentences_ += lines
                doc += [d] * len(lines)
        words = [x[2:].split(" ") for x in sentences_]
        size = np.array([len(x) for x in words], np.int64)
        ids = np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(size.sum()))
        rows, starts = np.array(index.rows)[ids], np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        if not len(size):
            return Maxima(words, sentences_, np.zeros(0, int), np.zeros((0, len(CATEGORIES))), np.zeros((0, len(CATEGORIES))))
        # Each sentence lies a step below the one before, so that no running sum reaches back into it.
        step = (np.repeat(np.arange(len(size)), size) * 1e4)[:, None]
        total = rows.cumsum(0)
        least = np.minimum.accumulate(total - rows - step)
        best = np.round(np.maximum.reduceat(total - step - least, starts), 5)
        return Maxima(words, sentences_, np.array(doc), np.maximum(best, 0.0), np.add.reduceat(np.maximum(rows, 0.0), starts))

    def rows(self, keys: list[str]) -> list[list[float]]:
        """Scores of each token; none if no token is listed."""
        for k in keys:
            if k in self.scores or "*" in k or k[1:] in self.scores:
                return [self.row(k) for k in keys]
        return []

    @staticmethod
    def _best(rows: list[list[float]], begin: int, end: int) -> tuple[float, int, int, int]:
        best = (0.0, 0, 0, 0)
        for c in range(len(CATEGORIES)):
            total, start = 0.0, begin
            for i in range(begin, end):
                total += rows[i][c]
                if total <= 0:
                    total, start = 0.0, i + 1
                elif total > best[0]:
                    best = (total, c, start, i + 1)
        return best


class _Index(dict):
    """Token -> place of its scores in rows; what is not listed is looked up once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.at = model, [model.drift], {}

    def __missing__(self, token: str) -> int:
        r = self.model.row(token)
        if r is self.model.drift:
            place = 0
        elif (place := self.at.get(id(r))) is None:
            place = self.at[id(r)] = len(self.rows)
            self.rows.append(r)
        self[token] = place
        return place


@dataclass
class Maxima:
    """Sentences of a batch: their words, lines and documents, best score and sum of the positive scores by category."""

    words: list[list[str]]
    lines: list[str]
    doc: np.ndarray
    best: np.ndarray
    positive: np.ndarray


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, keys) of docs (doc_id, text, cls), written once for all passes: a line a sentence, its language group and its keys parted by blanks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "cls": b.cls, "keys": ["\n".join(f"{speech(k)} {' '.join(k)}" for k in sentences(t)) for t in b.text]})

    return cut(fine(docs.select("doc_id", "text", F.col("cls").cast("double").alias("cls"))).mapInPandas(run, "doc_id long, cls double, keys string"))


def _lines(keys: str) -> list[tuple[int, list[str]]]:
    return [(int(x[0]), x[2:].split(" ")) for x in keys.split("\n")] if keys else []


def counted(keys: DataFrame) -> DataFrame:
    """(cls, speech, token, n) of keyed documents; the corpus counts of all documents have cls -1. Counts are summed within a batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for t, c in zip(b["keys"], b.cls):
                for g, ks in _lines(t):
                    ks = [k for k in ks if "*" not in k]
                    n.update((-1, g, k) for k in ks)
                    if c == c and c is not None:
                        n.update((int(c), g, k) for k in ks)
            yield pd.DataFrame([(*k, float(v)) for k, v in n.items()], columns=["cls", "speech", "token", "n"])

    return keys.select("keys", "cls").mapInPandas(run, "cls int, speech int, token string, n double").groupBy("cls", "speech", "token").agg(F.sum("n").alias("n"))


def passages(keys: DataFrame, model: Broadcast, least: float) -> DataFrame:
    """(cls, line): sentences whose best segment scores least or more, or the segment of one that is much longer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            out, x = [], m.maxima(list(b["keys"]))
            for k in np.flatnonzero(x.best.max(1) >= least) if len(x.best) else ():
                s = x.words[k]
                _, c, i, j = m.segment(s)
                # The words beside the segment belong to the passage.
                out.append((c, x.lines[k][:2] + " ".join(s if len(s) <= 3 * (j - i) + 4 else s[i:j])))
            yield pd.DataFrame(out, columns=["cls", "line"])

    return keys.select("keys").mapInPandas(run, "cls int, line string")


def taught(found_: DataFrame) -> DataFrame:
    """(cls, speech, token, n) of all passages."""
    per = found_.select("cls", F.substring("line", 1, 1).cast("int").alias("speech"), F.explode(F.split(F.substr("line", F.lit(3)), " ")).alias("token"))
    return per.filter(~F.contains("token", F.lit("*"))).groupBy("cls", "speech", "token").agg(F.count("*").cast("double").alias("n"))


def words(counts: DataFrame, corpus: DataFrame) -> pd.DataFrame:
    """(speech, token, n0, n1, .., corpus): how often each word of counts (cls, speech, token, n) is in each category and in corpus (speech, token, corpus), which has every word. Grows with the distinct words, not with the passages."""
    n = [F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0.0)).alias(f"n{c}") for c in range(len(CATEGORIES))]
    return counts.groupBy("speech", "token").agg(*n).join(corpus, ["speech", "token"]).toArrow().to_pandas()


def weighed(per: pd.DataFrame, total: list[float]) -> Model:
    """Dirichlet log-odds of each token of words() against the corpus without the category, within the language group of the token."""
    n = [f"n{c}" for c in range(len(CATEGORIES))]
    size = per.groupby("speech")[n].sum().reindex(range(3), fill_value=0.0).to_numpy().T
    drift = [min(-1.0, math.log(PRIOR / (s.sum() / 2 + PRIOR))) for s in size]
    # The language group of a token is the one that has it most often.
    home = per.sort_values(["token", "corpus", "speech"], ascending=[True, False, True]).drop_duplicates("token")
    g, seen, of = home["speech"].to_numpy(int), home["corpus"].to_numpy(float), np.array(total)
    a = PRIOR * (seen + 0.5) / (of[g] + 0.5)
    out, beside = np.zeros((len(home), len(CATEGORIES))), np.zeros((len(home), len(CATEGORIES)))
    for c in range(len(CATEGORIES)):
        x = home[n[c]].to_numpy(float)
        rest = beside[:, c] = np.maximum(seen - x, 0.0)
        odds = np.log((x + a) / (size[c, g] + PRIOR)) - np.log((rest + a + 0.01) / (np.maximum(of[g] - size[c, g], 1.0) + PRIOR))
        sd = np.sqrt(np.where(rest > 1, 1 / (x + a + 0.05) + 1 / (rest + a + 0.05), 1 / (x + 0.05)))
        # What lies above TOP counts little, but enough to tell categories apart.
        out[:, c] = np.maximum(drift[c], np.where(odds > SURE * sd, np.where(odds <= TOP, odds, TOP + 0.01 * (odds - TOP)), np.minimum(odds, -0.5)))
    listed = (out.max(1) > 0) | (seen >= 5)
    out, beside = out[listed], beside[listed]
    # Rare words have few different rows of scores; equal ones are one object.
    rows: dict[tuple[float, ...], list[float]] = {}
    model = Model({w: rows.setdefault(tuple(s), s) for w, s in zip(home["token"].to_numpy()[listed], out.tolist())}, drift)
    model.scale = max(scale_of(out[:, c].tolist(), beside[:, c].tolist(), drift[c], sum(total)) for c in range(len(CATEGORIES)))
    return model


def scale_of(scores: list[float], rest: list[float], drift: float, total: float) -> float:
    """Scale of the law of maxima: 1 / x of the x > 0 at which shares times exp(x score) sum to 1. scores and counts (beside the passages) of the listed tokens; all others score drift."""
    s, n = np.array(scores + [drift]), np.array(rest + [max(total - sum(rest), 1.0)]) + 0.5
    share = n / n.sum()
    low, high = 0.0, 1.0
    mass = lambda x: float((share * np.exp(np.minimum(x * s, 700))).sum())
    while mass(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mass(mid) < 1 else (low, mid)
    return 1 / high


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with cls: the category of a document that most reviews call toxic; null if there is none."""
    votes = labels.select("doc_id", "toxic", "category", "reviewer").distinct()
    per = votes.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"), F.mode("category").alias("category")).filter("toxic > 0.5 and category is not null")
    cls = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)])
    return docs.select("doc_id", "text").join(per.select("doc_id", F.try_element_at(cls, F.col("category")).alias("cls")), "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """(the model, the keyed documents)."""
    keys = keyed(labelled(docs, labels))
    counts = cut(counted(keys))
    corpus = counts.filter("cls = -1").select("speech", "token", F.col("n").alias("corpus"))
    sums = {r.speech: r.n for r in corpus.groupBy("speech").agg(F.sum("corpus").alias("n")).collect()}
    total = [float(sums.get(g) or 0.0) for g in range(3)]
    out = weighed(words(counts.filter("cls >= 0"), corpus), total)
    # The passages of a model, in all documents, teach the next with the words that they bring.
    for _ in range(ROUNDS):
        out = weighed(words(taught(passages(keys, docs.sparkSession.sparkContext.broadcast(out), FIRM)), corpus), total)
    return out, keys


def segments(keys: DataFrame, model: Model) -> DataFrame:
    """(doc_id, cls, score, n): the best segment of each sentence that holds a scored token, of further segments of TOP or more the best of each category with n 0, as only maxima are calibrated, and of each document at least one row."""

    held = keys.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            x = m.maxima(list(b["keys"]))
            top, cls, ids = (x.best.max(1), x.best.argmax(1), b.doc_id.to_numpy()[x.doc]) if len(x.best) else (np.zeros(0), np.zeros(0, int), np.zeros(0))
            any_ = top > 0
            out = [pd.DataFrame({"doc_id": ids[any_], "cls": cls[any_], "score": top[any_], "n": 1})]
            further: dict[tuple[int, int], float] = {}
            # Another segment of TOP or more needs as much beside the best one, in its category or in another.
            rest = x.positive.copy()
            rest[np.arange(len(top)), cls] -= top
            for k in np.flatnonzero(any_ & (rest.max(1, initial=0.0) >= TOP - 1e-4)):
                for score, c, _, _ in m.segments(x.words[k])[1:]:
                    if score >= TOP:
                        further[int(x.doc[k]), c] = max(score, further.get((int(x.doc[k]), c), 0.0))
            more = [(b.doc_id.iloc[d], c, score, 0) for (d, c), score in further.items()]
            none = np.bincount(x.doc[~any_], minlength=len(b)) if len(x.best) else np.zeros(len(b), int)
            out += [pd.DataFrame(more, columns=["doc_id", "cls", "score", "n"]), pd.DataFrame({"doc_id": b.doc_id, "cls": -1, "score": 0.0, "n": none})]
            out = pd.concat([o for o in out if len(o)]) if any(map(len, out)) else out[0]
            yield out[["doc_id", "cls", "score", "n"]]

    return keys.select("doc_id", "keys").mapInPandas(run, "doc_id long, cls int, score double, n int")


def location(scored: DataFrame, scale: float) -> float:
    """Location of the Gumbel law of that scale at which as many sentences lie above the median of the maxima between 0 and FIRM as do; passages take no part. Without such a sentence 0."""
    bins = scored.filter(F.col("n") > 0).filter(F.col("score") < FIRM).groupBy((F.floor(F.col("score") * 10) / 10).alias("s")).agg(F.sum("n").alias("n")).orderBy("s").collect()
    n, above = sum(r.n for r in bins), sum(r.n for r in bins if r.s > 0)
    left = above
    for r in bins:
        if r.s > 0:
            if left - r.n <= above / 2:
                return float(r.s) + scale * math.log(-math.log(1 - min(left / n, 1 - 1e-12)))
            left -= r.n
    return 0.0


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category, score, p_value, significant): one row a document and category with a segment; documents without one have category null, score 0, p_value 1."""
    model, keys = fit(docs, labels)
    scored = cut(segments(keys, model))
    beta = model.scale
    mu = location(scored, beta)
    name = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("cls"))
    per = scored.groupBy("doc_id", "cls").agg(F.max("score").alias("score"))
    top = per.groupBy("doc_id").agg(F.max("score").alias("top"))
    out = per.join(top, "doc_id").filter("score > 0 or top = 0")
    p = 1 - F.exp(-F.exp(-(F.col("score") - mu) / beta))
    p = F.when(F.col("score") > 0, p).otherwise(1.0)
    return out.select("doc_id", F.when(F.col("cls") >= 0, name).alias("category"), "score", p.alias("p_value"), (p < ALPHA).alias("significant"))


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category) of each category that a document has a significant passage of."""
    return scores(docs, labels).filter("significant").select("doc_id", "category").distinct()


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: documents, documents with any and with each category, and the share with any. A null source is a source of its own."""
    hit = found(docs, labels).groupBy("doc_id").agg(*[F.max((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES])
    per = docs.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source")
    return per.agg(F.count("*").alias("n_docs"), F.count(CATEGORIES[0]).alias("n_toxic"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in CATEGORIES]).withColumn("toxic_rate", F.col("n_toxic") / F.col("n_docs"))
