"""Noise of scanned pages: broken words, misread words, running headers, page numbers; and the repair into continuous text.

Records are parsed once into lines, words and breaks. Word counts of all records give the vocabulary; every form meets candidates
through inverted joins on its rarest character q-grams, by length and place, and boosted trees over the aligned pair rank the candidates. Breaks (two halves
of a line pair), lines that may be running headers and lines that may be page numbers are judged by classifiers over counts of the joined, the hyphenated and
the halves, and over how a line recurs in its book, stands between its neighbours, carries a number and equals a section or the title. All
four are trained here on words of the vocabulary (at most TRAIN of them) with noise written into them, and on lines that show what they are.
What a form must be more frequent than is relative to the form alone (TIMES), so recall depends neither on the size of a corpus nor on the share of a language.

The repair edits the original text at the places of the cases only: lines that are furniture go, broken words are joined, misread words put right, wrapped
lines of a paragraph joined by a blank; every other character stays as it is.

Defined results: null and empty texts have no noise; repeated records count once; a null book is a book of its own; ties between
candidates go to the more frequent, then the smaller word; a word cut off by the end of its text is no case. Texts and lines are read whole.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.gbt import Boosted
from kiln.llm.lookalike import CYRILLIC_LATIN, LATIN_CYRILLIC
from kiln.session import cut, fine

#: Words of the vocabulary that the classifiers are trained on, at most.
TRAIN = 1500
#: What a form should read stands at least so often, and at least TIMES as often as the form.
KNOWN, TIMES = 3, 6
Q, EDITS = 2, 2

# What scanning takes for what, by groups of letters of one look.
CONFUSIONS = [("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("i", "j"), ("s", "5"), ("o", "6"), ("ö", "6"), ("ö", "o"), ("b", "6"), ("g", "9"), ("z", "2"), ("b", "8"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("d", "cl"), ("h", "li"), ("h", "b"), ("u", "ii"), ("u", "n"), ("nn", "rm"), ("n", "ri"), ("w", "vv"), ("e", "c"), ("a", "o"), ("g", "q"), ("t", "f"), ("y", "v"), ("c", "o"), ("f", "t"), ("k", "lc"), ("ü", "u"), ("ä", "a"), ("r", "i"), ("ß", "b"), ("ß", "ss"), ("fi", "h"), ("а", "о"), ("о", "0"), ("о", "с"), ("н", "п"), ("н", "и"), ("т", "г"), ("л", "д"), ("и", "н"), ("е", "с"), ("ж", "х"), ("й", "и"), ("з", "3"), ("з", "э"), ("б", "6"), ("ш", "щ"), ("ш", "пг"), ("ы", "ь"), ("в", "з"), ("в", "н"), ("ц", "ч"), ("ц", "п"), ("п", "л"), ("м", "н"), ("ю", "ю"), ("ч", "4"), ("ё", "е"), ("р", "г"), ("к", "н"), ("у", "х"), ("ф", "ср")]
_PAIRS = {(a, b) for x, y in CONFUSIONS for a, b in ((x, y), (y, x)) if a != b}
SUSPENDED = {"and", "or", "to", "und", "oder", "bis", "и", "или", "а", "до", "но"}

_WORD = re.compile(r"[^\W_]+(?:[-’'‑][^\W_]+)*")
_CAPTION = re.compile(r"^(?:Fig(?:ure|\.)?|Table|Tab\.|Рис(?:унок|\.)?|Табл(?:ица|\.)|Bild|Abb(?:ildung|\.)?|Tabelle|!\[|\\includegraphics|\[\[File|<img)", re.I)
_PAGE = [re.compile(p, re.I) for p in (r"^[-–—·•*|\[(]\s?(\d{1,4})\s?[-–—·•*|\])]$", r"^(\d{1,4})$", r"^(?:page|p\.|pg\.?|seite|s\.|стр\.|страница|с\.)\s?(\d{1,4})\.?$", r"^(\d{1,4})\.$")]
_SIDE = [re.compile(r"^(?P<h>\S.{2,}?)\s*(?:[|·•—–]|\s{2,}|\t)\s*(?P<n>\d{1,4})$"), re.compile(r"^(?P<n>\d{1,4})(?:\s*[|·•—–]\s*|\s{2,}|\t|\s(?=[A-ZА-ЯЁÄÖÜ]))(?P<h>[^\d\s].{2,})$")]
_MARKUP = re.compile(r"[\\{}<>$=`~]|\|\||^\||\|$|^[-*#=]+\s|^\d+[.)]\s")
_END = re.compile(r"[.!?:;…»\"”)\]]$|\$\$$|</?\w+>$")
_MIX = (re.compile("[a-zäöüß]", re.I), re.compile("[а-яё]", re.I))


#: Format characters but the soft hyphen, which marks broken words.
_FORMAT = re.compile("[\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
#: Stands in the working form for a character that is a sign of its own (superscripts, fractions), so that it parts words.
_SIGN = "\ue000"


@lru_cache(4096)
def _plain(cluster: str) -> str:
    """Compatibility form of a character with its marks; nothing for a format character."""
    if len(cluster) == 1:
        if unicodedata.category(cluster) == "Cf":
            return cluster if cluster == "\u00ad" else ""
        if unicodedata.decomposition(cluster).startswith(("<super>", "<sub>", "<fraction>")):
            return _SIGN
    return unicodedata.normalize("NFKC", cluster)


def working(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """(working form: compatibility form without invisible characters; for each of its characters the start and the end of what it comes from in text, None where both are equal)."""
    if text.isascii() or (unicodedata.is_normalized("NFKC", text) and not _FORMAT.search(text)):
        return text, None, None
    out, starts, ends, i, n = [], [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and text[j] > "\u02ff" and unicodedata.combining(text[j]):
            j += 1
        x = text[i:j]
        x = x if x < "\u0080" and j == i + 1 else _plain(x)
        out.append(x)
        starts += [i] * len(x)
        ends += [j] * len(x)
        i = j
    return "".join(out), starts, ends


def word_form(w: str) -> str:
    """Lower case, letters of the other script brought to the word's own."""
    w = w.lower()
    if not w.isascii() and (a := len(_MIX[0].findall(w))) and (b := len(_MIX[1].findall(w))):
        table = CYRILLIC_LATIN if a >= b else LATIN_CYRILLIC
        w = "".join(table.get(c, c) for c in w)
    return w


_OPEN = re.compile(r"(?:```|~~~|<pre|<syntaxhighlight|\\begin\{(?:verbatim|lstlisting|tabular|equation|align))")
_CLOSED = re.compile(r"(?:</pre>|</syntaxhighlight>|\\end\{\w+\*?\})$")
_CLOSE = re.compile(r"</pre>|</syntaxhighlight>|\\end\{(?:verbatim|lstlisting|tabular|equation|align)")
_BROKEN = re.compile(r"([^\W\d_][^\s]*?)([-¬\u00ad–‐])$")
_DIGITS = re.compile(r"[\d\s.,;|&-]+$")


class Page:
    """Lines, words and breaks of a text, with their places in its working form."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = working(text)
        self.lines = self.text.split("\n")
        self.offsets = [0]
        for x in self.lines:
            self.offsets.append(self.offsets[-1] + len(x) + 1)
        self.bare = [x.strip() for x in self.lines]
        #: Lines of code, tables and display formulas.
        self.fenced: set[int] = set()
        #: (key, as it stands, page, blank before, blank after, open before, low after, markup near, line, form of the number, first or last, numbers beside).
        self.shorts: list[tuple] = []
        #: (left, right, mark, start of the mark, start of the right half).
        self.breaks: list[tuple[str, str, str, int, int]] = []
        self.words: list[tuple[str, int, int]] = []
        self._read_lines()
        self._read_words()

    def _read_lines(self) -> None:
        fenced, last, before = False, "", []
        for s in self.bare:
            before.append(last)
            last = s or last
        last, after = "", []
        for s in reversed(self.bare):
            after.append(last)
            last = s or last
        after.reverse()
        self.intruders: set[int] = set()
        for i, s in enumerate(self.bare):
            if _OPEN.match(s):
                self.fenced.add(i)
                fenced = not fenced if s.startswith(("```", "~~~")) else not _CLOSED.search(s)
                continue
            if fenced:
                self.fenced.add(i)
                fenced = not _CLOSE.search(s)
                continue
            if not s or _CLOSE.search(s) or _CAPTION.match(s):
                continue
            head, page, form = s, None, -1
            if s[0].isdigit() or s[-1].isdigit() or s[-1] in ".-–—·•*|)]":
                for k, p in enumerate(_PAGE):
                    if m := p.match(s):
                        head, page, form = "", m[1], k
                        break
                else:
                    for p in _SIDE:
                        if m := p.match(s):
                            head, page, form = m["h"].strip(), m["n"], len(_PAGE)
                            break
            if page is None and (s[-1] in "-¬\u00ad–‐" or _END.search(s) or sum(c.isalpha() for c in s) < 4 or _MARKUP.search(s)):
                continue
            x, y = before[i], after[i]
            blank_before, blank_after = i == 0 or not self.bare[i - 1], i + 1 == len(self.bare) or not self.bare[i + 1]
            beside = sum(bool(z) and (bool(_DIGITS.match(z)) or z[0] == "|" or z[-1] in "|&\\") for z in (x, y))
            self.shorts.append((" ".join(head.lower().split()), head, page, blank_before, blank_after, bool(x) and not _END.search(x), bool(y) and y[0].islower(), bool(_MARKUP.search(head)), i, form, not x or not y, beside))
            if page is not None:
                self.intruders.add(i)

    def _next_half(self) -> tuple[list[int], list[int]]:
        """For each line the next line that goes on with a small letter, and the next that goes on with a word at all, past blank lines, furniture, captions and headings, but not past other text."""
        low, any_, out = -1, -1, []
        for i in range(len(self.lines) - 1, -1, -1):
            out.append((low, any_))
            s = self.bare[i]
            if not s or i in self.intruders:
                continue
            w = _WORD.match(s)
            if w and s[0].islower():
                low = any_ = i
            else:
                any_ = i if w and len(w[0]) > 1 else any_
                # A sentence that ends here is text of its own: nothing before it goes on after it.
                low = -1 if _END.search(s) and not _CAPTION.match(s) and i not in self.fenced else low
        out.reverse()
        return [x for x, _ in out], [y for _, y in out]

    def _read_words(self) -> None:
        low, any_ = self._next_half()
        skip: set[int] = set()
        for i, raw in enumerate(self.lines):
            if i in self.intruders:
                continue
            s, base = raw.rstrip(), self.offsets[i]
            found = [(base + m.start(), m[0]) for m in _WORD.finditer(s)]
            if i in skip:
                found = found[1:]
            m = _BROKEN.search(s)
            if m and found and s[: m.end(1)].endswith(found[-1][1]):
                j = any_[i] if m[2] in "¬\u00ad" and any_[i] >= 0 else low[i]
                if j >= 0 and j not in skip:
                    nxt = self.bare[j]
                    at = self.offsets[j] + self.lines[j].index(nxt)
                    self.breaks.append((word_form(found[-1][1]), word_form(_WORD.match(nxt)[0]), m[2], base + m.end(1), at))
                    skip.add(j)
                found = found[:-1]
            k = 0
            while k < len(found):
                at, w = found[k]
                end = at + len(w)
                if k + 1 < len(found):
                    gap, nxt = self.text[end : found[k + 1][0]], found[k + 1][1]
                    if len(gap) > 1 and gap[0] in "-¬\u00ad" and not gap[1:].strip(" ") and nxt[0].islower() and w[-1].isalpha() and nxt.lower() not in SUSPENDED:
                        self.breaks.append((word_form(w), word_form(nxt), " ", end, found[k + 1][0]))
                        k += 2
                        continue
                self.words.append((word_form(w), at, end))
                k += 1

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Span of the original text that characters a to b of the working form come from."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1]) if b > a else (self.starts[a],) * 2


_SHORT = ("key", "head", "page", "b", "a", "open", "low", "markup", "at", "form", "edge", "beside")


def parse(text: str | None) -> tuple[list[str], list[tuple[str, str, str]], list[tuple]]:
    """(words, breaks as (left, right, mark), lines that may be furniture as in Page.shorts)."""
    if not text:
        return [], [], []
    p = Page(text)
    return [w for w, _, _ in p.words], [x[:3] for x in p.breaks], p.shorts


def records(chunks: DataFrame, audit: DataFrame) -> DataFrame:
    """(record_kind, record_key, book, section, text) of chunks.text and audit_log.before_text; the book of an audit row is that of its chunk id."""
    a = chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_key"), "book", "section", "text")
    b = audit.select(F.lit("audit").alias("record_kind"), F.col("audit_id").cast("string").alias("record_key"), F.regexp_replace("chunk_id", r"_[^_]*$", "").alias("book"), F.lit(None).cast("string").alias("section"), F.col("before_text").alias("text"))
    return a.unionByName(b)


_PARSED = "rid string, record_kind string, record_key string, book string, section string, words array<string>, breaks array<struct<l:string,r:string,mark:string>>, shorts array<struct<key:string,head:string,page:string,b:boolean,a:boolean,open:boolean,low:boolean,markup:boolean,at:int,form:int,edge:boolean,beside:int>>"


def identified(rows: DataFrame) -> DataFrame:
    """Distinct records with rid, a 128-bit digest of all their fields; small tables are spread by it on the way."""
    rid = F.md5(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0000")) for c in ("record_kind", "record_key", "book", "section", "text")]))
    return fine(rows.withColumn("rid", rid), by=("rid",)).distinct()


def parsed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["rid", "record_kind", "record_key", "book", "section"]].copy()
            p = [parse(t) for t in b.text]
            for i, (c, names) in enumerate((("words", None), ("breaks", ("l", "r", "mark")), ("shorts", _SHORT))):
                out[c] = [x[i] if names is None else [dict(zip(names, y)) for y in x[i]] for x in p]
            yield out

    return rows.mapInPandas(run, _PARSED)


def word_counts(p: DataFrame, audit: DataFrame) -> DataFrame:
    """(word, n): words of all records and of the corrected audit texts; parts of hyphenated words count too."""
    after = audit.filter("after_text is not null").select(F.col("after_text").alias("text"))
    right = after.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+(?:[-’'‑][\p{L}\p{N}]+)*)"), 1)).alias("word"))
    whole = p.select(F.explode("words").alias("word")).unionByName(right)
    parts = whole.withColumn("word", F.explode(F.when(F.col("word").contains("-"), F.concat(F.array("word"), F.split("word", "-"))).otherwise(F.array("word"))))
    return parts.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


# --- misread words -------------------------------------------------------------------------------------------------------------------


def misreadable(w: str) -> bool:
    """Forms that can be a misread word: letters with at most a third of digits, no unit behind a number."""
    letters = sum(c.isalpha() for c in w)
    if len(w) < 4 or letters < 3:
        return False
    digits = len(w) - letters
    return digits == 0 or (digits * 3 <= len(w) and not re.match(r"\d+(?:[.,]\d+)?\D{1,3}$|\d{2}", w) and not re.match(r"\D{1,2}\d+$", w))


@lru_cache(100_000)
def cost(a: str, b: str) -> tuple[float, int, int]:
    """(least cost, listed confusions, other edits) of reading a for b: a listed confusion costs 0.3, any other edit 1."""
    # What both have at either end costs nothing; two letters stay, as a confusion may reach into them.
    k, top = 0, min(len(a), len(b))
    while k < top and a[k] == b[k]:
        k += 1
    k = max(k - 2, 0)
    a, b, j, top = a[k:], b[k:], 0, top - k
    while j < top and a[-1 - j] == b[-1 - j]:
        j += 1
    if j > 2:
        a, b = a[: 2 - j], b[: 2 - j]
    n, m = len(a), len(b)
    inf = (9e9, 0, 0)
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            c, x, y = d[i][j]
            if c >= 9e9:
                continue
            for p in range(0, 3):
                for q in range(0, 3):
                    if (p or q) and i + p <= n and j + q <= m:
                        s, t = a[i : i + p], b[j : j + q]
                        if s == t and p == 1:
                            new = (c, x, y)
                        elif (s, t) in _PAIRS:
                            new = (c + 0.3, x + 1, y)
                        elif p <= 1 and q <= 1:
                            new = (c + 1, x, y + 1)
                        else:
                            continue
                        if new < d[i + p][j + q]:
                            d[i + p][j + q] = new
    return d[n][m]


def pair_features(a: str, b: str, na: float, nb: float) -> list[float]:
    c, x, y = cost(a, b)
    ga, gb = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return [c, x, y, len(a), len(b) - len(a), len(ga & gb) / max(1, len(ga | gb)), math.log1p(nb) - math.log1p(na), math.log1p(nb), math.log1p(na), float(any(ch.isdigit() for ch in a)), float(a[0] == b[0]), float(a[-1] == b[-1]), float(b.startswith(a) or a.startswith(b)), c / max(1, len(b))]


def misread(w: str, rnd: random.Random) -> str:
    """A word with one listed confusion written into it."""
    ways = [(i, x, y) for x, y in _PAIRS for i in range(len(w) - len(x) + 1) if w[i : i + len(x)] == x and not x[0].isdigit()]
    if not ways:
        return w
    i, x, y = rnd.choice(sorted(ways))
    return w[:i] + y + w[i + len(x) :]


def train_ranker(words: list[tuple[str, int]], seed: int = 3) -> Boosted:
    """Trees that tell the right reading from near words; words: (word, count) of the vocabulary."""
    rnd, draw = random.Random(seed), np.random.default_rng(seed)
    places: dict[str, list[int]] = {}
    for k, (w, _) in enumerate(words):
        for i in range(len(w) - 1):
            places.setdefault(w[i : i + 2], []).append(k)

    def near(a: str) -> list[int]:
        n = Counter(k for i in range(len(a) - 1) for k in places.get(a[i : i + 2], ()))
        return [k for k, v in n.most_common(6) if abs(len(words[k][0]) - len(a)) <= 2 and v >= 2]

    x, y = [], []
    for w, n in words:
        a = misread(w, rnd)
        if a != w:
            na = float(draw.poisson(n * rnd.choice([0.0, 0.001, 0.005, 0.01, 0.03, 0.05])))
            x.append(pair_features(a, w, na, n))
            y.append(1)
            # What stands for a tenth of a frequent word is a word of its own, however near.
            if (often := n * rnd.uniform(0.06, 1 / TIMES)) >= 8:
                x.append(pair_features(a, w, often, n))
                y.append(0)
            for k in near(a):
                f = pair_features(a, words[k][0], na, words[k][1])
                if words[k][0] != w and f[2] > 0:
                    x.append(f)
                    y.append(0)
        # A sound rare word, and a sound word beside its own other forms, are not to be changed.
        # Forms that listed confusions explain in full are left out: the vocabulary itself holds frequent misreadings.
        for k in near(w)[:4]:
            f = pair_features(w, words[k][0], min(n, words[k][1] * 0.05), words[k][1])
            if words[k][0] != w and f[2] > 0:
                x.append(f)
                y.append(0)
        stem = w + rnd.choice(["s", "e", "en", "ing", "er", "а", "ы", "и", "ов", "ом", "ed", "n", "m"]) if rnd.random() < 0.7 else w[:-1]
        if len(stem) > 3:
            x.append(pair_features(stem, w, rnd.choice([0, 1, 2]), n))
            y.append(0)
    if not y or min(y) == max(y):
        x, y = x + [pair_features("wcrd", "word", 0, 9), pair_features("wards", "word", 1, 9)], y + [1, 0]
    return Boosted(1, rounds=30, depth=4).fit(np.array(x), np.array(y))


def grams(df: DataFrame) -> DataFrame:
    """Columns of df with each distinct gram of its word, the grams' first places and the word's length."""
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    all_ = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.struct(F.substr(padded, i, F.lit(Q)).alias("gram"), i.alias("at")))
    return df.select("*", F.length("word").alias("size"), F.explode(all_).alias("g")).select(*df.columns, "size", "g.gram", "g.at").groupBy(*df.columns, "size", "gram").agg(F.min("at").alias("at"))


def candidates(sought: DataFrame, known: DataFrame) -> DataFrame:
    """(word, n, right, n_right): forms with the known words that share one of their rarest grams at the same place but for EDITS, are as long but for EDITS and stand TIMES as often.

    The key of the join is the gram with the length, so the lists are short; a list that is still long is split by the skew join of adaptive execution."""
    right = grams(known.select("word", "n")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "size", "gram", F.col("at").alias("at_right"))
    df = right.groupBy("gram").agg(F.count("*").alias("df"))
    # The rarest grams of a form: with EDITS edits of Q grams each, one of these is in the right word.
    left = grams(sought.select("word", "n")).join(df, "gram", "left").withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "gram"))).filter((F.col("rank") <= Q * EDITS + 3) & F.col("df").isNotNull())
    left = left.select("word", "n", "gram", "at", F.explode(F.sequence(F.col("size") - EDITS, F.col("size") + EDITS)).alias("size"))
    met = left.join(right, ["gram", "size"]).filter((F.abs(F.col("at") - F.col("at_right")) <= EDITS) & (F.col("n_right") >= TIMES * F.col("n")) & (F.col("word") != F.col("right")))
    return met.filter(F.levenshtein("word", "right", 3) >= 0).select("word", "n", "right", "n_right").distinct()


def corrections(counts: DataFrame, extra: DataFrame) -> DataFrame:
    """(word, right): misread forms and what they should read. counts: (word, n); extra: (word) forms to look up besides, with count 0 unless counted."""
    known = cut(counts.filter((F.col("n") >= KNOWN) & F.col("word").rlike(r"^\p{L}{3,}$")))
    sought = counts.filter(~F.col("word").contains("-")).unionByName(extra.select("word").distinct().join(counts, "word", "left_anti").withColumn("n", F.lit(0).cast("long")))
    sought = cut(sought.filter(F.length("word") >= 4).filter(F.col("word").rlike(r"\p{L}.*\p{L}.*\p{L}") & ~F.col("word").rlike(r"^\d+\D{1,3}$|^\d{2}|^\D{1,2}\d+$")))
    pairs = candidates(sought, known)
    sample = [(r.word, r.n) for r in known.orderBy(F.xxhash64("word"), "word").limit(TRAIN).collect()]
    model = train_ranker(sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[misreadable(w) for w in b.word]] if len(b) else b
            p = model.prob(np.array([pair_features(*r) for r in zip(b.word, b.right, b.n, b.n_right)]).reshape(len(b), -1))[:, 0] if len(b) else []
            yield pd.DataFrame({"word": b.word, "right": b.right, "n_right": b.n_right, "p": p})

    ranked = fine(pairs, by=("word",)).mapInPandas(score, "word string, right string, n_right long, p double").filter("p > 0.5")
    return ranked.groupBy("word").agg(F.max_by("right", F.struct(F.round("p", 2), "n_right", "right")).alias("right"))


# --- broken words --------------------------------------------------------------------------------------------------------------------


def break_features(joined: float, left: float, right: float, whole: float, len_left: int, len_right: int, certain: bool, times: float) -> list[float]:
    return [math.log1p(times), math.log1p(joined), math.log1p(left), math.log1p(right), math.log1p(whole), math.log1p(joined) - math.log1p(min(left, right)), math.log1p(joined) - math.log1p(whole), min(len_left, 6), min(len_right, 6), float(certain)]


def train_breaks(words: list[tuple[str, int]], compounds: list[tuple[str, int]], known: dict[str, int], seed: int = 9) -> Boosted:
    """Trees that tell a broken word from a word hyphenated by right: words cut at random, and hyphenated words cut at their hyphen."""
    rnd, x, y = random.Random(seed), [], []
    for w, n in words:
        if len(w) >= 5:
            k = rnd.randint(2, len(w) - 2)
            for joined in (n, 0 if rnd.random() < 0.3 else n):
                x.append(break_features(joined, known.get(w[:k], 0), known.get(w[k:], 0), 0, k, len(w) - k, rnd.random() < 0.2, rnd.randint(1, 3 + joined // 100)))
                y.append(1)
    for w, n in compounds:
        a, b = w.rsplit("-", 1)
        for whole in (n, 0):
            x.append(break_features(known.get(a + b, 0), known.get(a.rsplit("-", 1)[-1], 0), known.get(b, 0), whole, len(a), len(b), False, rnd.randint(1, 200)))
            y.append(0)
    # Two words of the vocabulary that are known apart but not as one.
    for (a, n), (b, m) in zip(words[::2], words[1::2]):
        # The right half may be counted nowhere else; then the break recurs at one place and the word is never seen whole.
        for right, times in ((m, rnd.randint(1, 30)), (0, rnd.randint(8, 200))):
            x.append(break_features(known.get(a + b, 0), n, right, 0, len(a), len(b), False, times))
            y.append(0)
    if not y or min(y) == max(y):
        x, y = x + [break_features(9, 0, 0, 0, 3, 3, False, 1), break_features(0, 9, 9, 0, 5, 5, False, 1)], y + [1, 0]
    return Boosted(1, rounds=20, depth=3).fit(np.array(x), np.array(y))


def broken(p: DataFrame, counts: DataFrame) -> DataFrame:
    """(l, r, mark, joined): breaks that are one word."""
    pairs = cut(p.select(F.explode("breaks").alias("b")).groupBy("b.l", "b.r", "b.mark").agg(F.count("*").alias("times")))
    # A half may itself be a compound: what is judged is the part at the break.
    half_l, half_r = F.element_at(F.split("l", "-"), -1), F.element_at(F.split("r", "-"), 1)
    rows = pairs.withColumn("times", F.sum("times").over(Window.partitionBy("l", "r"))).withColumn("left", half_l).withColumn("right", half_r).withColumn("one", F.concat("left", "right")).withColumn("two", F.concat_ws("-", "left", "right"))
    for c in ("one", "two", "left", "right"):
        rows = rows.join(counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    known = counts.filter("n >= 3 and word rlike '^[^0-9]+$'").orderBy(F.xxhash64("word"), "word")
    words = [(r.word, r.n) for r in known.filter(~F.col("word").contains("-") & (F.length("word") >= 3)).limit(TRAIN).collect()]
    compounds = [(r.word, r.n) for r in known.filter(F.col("word").contains("-")).limit(TRAIN).collect()]
    halves = {h for w, _ in words for k in range(2, len(w) - 1) for h in (w[:k], w[k:])} | {h for w, _ in compounds for h in w.split("-")}
    need = p.sparkSession.createDataFrame([(h,) for h in sorted(halves)] or [("",)], "word string")
    table = {r.word: r.n for r in counts.join(need, "word", "left_semi").collect()}
    model = train_breaks(words, compounds, table)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([break_features(*r[:4], len(r[4]), len(r[5]), r[6] in "¬­", r[7]) for r in zip(*(b[c].fillna(0) for c in ("n_one", "n_left", "n_right", "n_two")), b.left, b.right, b.mark, b.times)]).reshape(len(b), -1)
            q = model.prob(x)[:, 0] if len(b) else np.zeros(0)
            yield pd.DataFrame({"l": b.l, "r": b.r, "mark": b.mark, "joined": b.l + b.r})[q > 0.5]

    return rows.mapInPandas(judge, "l string, r string, mark string, joined string")


# --- furniture -----------------------------------------------------------------------------------------------------------------------


def _title(c: str) -> Column:
    return F.array_join(F.split(F.lower(F.trim(c)), r"\s+"), " ")


def line_table(p: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per book and line: how often it stands, with a page number, within open text, as section, as the book's title; the same over all books."""
    sections = p.filter("section is not null").select(_title("section").alias("key")).groupBy("key").agg(F.count("*").alias("n_section"))
    titles = catalog.filter("book is not null").select("book", _title("title").alias("key")).distinct().withColumn("title", F.lit(1))
    lines = p.select("record_kind", F.coalesce("book", F.lit("")).alias("book"), F.explode("shorts").alias("s")).filter("s.head <> '' and not s.markup and length(s.head) >= 4")
    per = lines.groupBy("book", F.col("s.key").alias("key")).agg(
        F.count("*").alias("n"), F.count("s.page").alias("paged"), F.sum((F.col("s.open") & F.col("s.low")).cast("int")).alias("within"), F.sum((~F.col("s.b") | ~F.col("s.a")).cast("int")).alias("tight"), F.sum(F.col("s.open").cast("int")).alias("open"),
    )
    over = per.groupBy("key").agg(F.sum("n").alias("all_n"), F.sum("paged").alias("all_paged"), F.sum("within").alias("all_within"), F.sum("tight").alias("all_tight"), F.count("*").alias("books"))
    return per.join(over, "key").join(sections, "key", "left").join(titles, ["book", "key"], "left").na.fill(0, ["n_section", "title"])


def line_features(r) -> list[float]:
    return [math.log1p(r.n), r.paged / r.n, r.within / r.n, r.open / r.n, r.tight / r.n, math.log1p(r.all_n), r.all_paged / r.all_n, r.all_within / r.all_n, r.all_tight / r.all_n, float(r.n_section > 0), r.n_section / (r.all_n + 1), float(r.title), len(r.key), len(r.key.split())]


#: Lines that show what they are wherever they stand, so that the trees are taught on small tables too: (features as in line_features, header or not).
_LINES = [([math.log1p(9), 0.8, 0.5, 0.8, 0.5, math.log1p(9), 0.8, 0.5, 0.5, 0, 0, 0, 24, 4], 1), ([math.log1p(1), 0, 0, 0, 0, math.log1p(1), 0, 0, 0, 0, 0, 0, 40, 7], 0)]


def taught(x: list[list[float]], y: list[int], seeds: list[tuple[list[float], int]], rounds: int) -> Boosted:
    """Trees over rows with labels and the rows of seeds; both classes weigh the same, however few one has."""
    x, y = x + [f for f, _ in seeds], y + [k for _, k in seeds]
    ones = sum(y)
    return Boosted(1, rounds=rounds, depth=3).fit(np.array(x, float), np.array(y), len(y) / 2 / np.where(np.array(y) == 1, ones, len(y) - ones))


def headers(p: DataFrame, catalog: DataFrame) -> DataFrame:
    """(book, key): lines that are running headers of their book."""
    t = cut(line_table(p, catalog))
    # Lines that show what they are: repeated with page numbers, or the title of their book; section names; lines that stand once.
    sure = t.filter("n_section = 0 and ((all_paged >= 2 and all_n >= 3) or title = 1)").orderBy(F.xxhash64("book", "key"), "book", "key").limit(TRAIN).collect()
    # ... and lines that recur, but never with a page number, within an open sentence or with blank lines about them: wrapped text and underlined headings.
    never = t.filter("n_section > 0 or (all_paged = 0 and title = 0 and (all_n = 1 or (all_within = 0 and all_tight = all_n)))").orderBy(F.xxhash64("book", "key"), "book", "key").limit(TRAIN).collect()
    model = taught([line_features(r) for r in sure] + [line_features(r) for r in never], [1] * len(sure) + [0] * len(never), _LINES, 15)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = model.prob(np.array([line_features(r) for r in b.itertuples()]).reshape(len(b), -1))[:, 0] if len(b) else np.zeros(0)
            yield b[["book", "key"]][q > 0.5]

    return t.mapInPandas(judge, "book string, key string")


def page_features(r) -> list[float]:
    """Of a number that stands alone in its line, beside the lines before and after it."""
    return [*(float(r.form == k) for k in range(len(_PAGE))), len(r.page), float(r.b), float(r.a), float(r.open), float(r.low), float(r.edge), r.beside, math.log1p(r.n_form)]


#: As _LINES: a dashed number between blank lines, a number within an open sentence; a cell of a column, the tail of a paragraph.
_PAGES = [([1, 0, 0, 0, 2, 1, 1, 0, 0, 0, 0, 1], 1), ([0, 1, 0, 0, 3, 1, 1, 1, 1, 0, 0, 1], 1), ([0, 1, 0, 0, 3, 0, 0, 0, 0, 0, 2, 1], 0), ([0, 1, 0, 0, 3, 0, 1, 1, 0, 0, 0, 1], 0)]


def page_lines(p: DataFrame) -> DataFrame:
    """(rid, at): lines that hold a page number alone."""
    lines = p.select("rid", F.coalesce("book", F.lit("")).alias("book"), F.explode("shorts").alias("s")).filter("s.head = '' and s.page is not null").select("rid", "book", "s.*")
    per = lines.groupBy("book", "form").agg(F.count("*").alias("n_form"))
    t = cut(lines.join(per, ["book", "form"]).select("rid", "page", "b", "a", "open", "low", "at", "form", "edge", "beside", "n_form"))
    # Numbers that show what they are: dressed as page numbers, alone between blank lines, within an open sentence; numbers in columns and at the tail of a paragraph.
    some = lambda c: t.filter(c).orderBy(F.xxhash64("rid", "at"), "rid", "at").limit(TRAIN).collect()
    sure = some("form in (0, 2) or (beside = 0 and ((b and a) or (open and low)))")
    never = some("form in (1, 3) and (beside > 0 or (not b and a and not (open and low)))")
    model = taught([page_features(r) for r in sure] + [page_features(r) for r in never], [1] * len(sure) + [0] * len(never), _PAGES, 15)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = model.prob(np.array([page_features(r) for r in b.itertuples()]).reshape(len(b), -1))[:, 0] if len(b) else np.zeros(0)
            yield b[["rid", "at"]][q > 0.5]

    return t.mapInPandas(judge, "rid string, at int")


# --- results -------------------------------------------------------------------------------------------------------------------------


def analyse(rows: DataFrame, audit: DataFrame, catalog: DataFrame) -> dict[str, DataFrame]:
    """Parsed records with the tables of right words, whole words, headers and lines of page numbers. rows: identified records."""
    p = cut(parsed(rows))
    counts = cut(word_counts(p, audit))
    whole = cut(broken(p, counts))
    right = cut(corrections(counts, whole.select(F.col("joined").alias("word"))))
    return {"parsed": p, "whole": whole, "right": right, "headers": cut(headers(p, catalog)), "pages": cut(page_lines(p))}


def furniture(t: dict[str, DataFrame]) -> DataFrame:
    """(rid, record_kind, record_key, at, head, page): lines that are headers or page numbers."""
    lines = t["parsed"].select("rid", "record_kind", "record_key", F.coalesce("book", F.lit("")).alias("book"), F.explode("shorts").alias("s"))
    lines = lines.select("rid", "record_kind", "record_key", "book", "s.key", "s.at", "s.head", "s.page")
    heads = lines.filter("head <> ''").join(t["headers"], ["book", "key"], "left_semi")
    return heads.unionByName(lines.join(t["pages"], ["rid", "at"], "left_semi")).drop("book", "key")


def noise(chunks: DataFrame, audit: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record_kind, record_key, noise, fragment): each distinct case."""
    t = analyse(identified(records(chunks, audit)), audit, catalog)
    p, right = t["parsed"], t["right"]
    ident = ["record_kind", "record_key"]
    words = p.select(*ident, F.explode(F.array_distinct("words")).alias("token"))
    # A hyphenated word is looked up by its parts.
    parts = words.withColumn("i", F.when(F.col("token").contains("-"), F.sequence(F.lit(0), F.size(F.split("token", "-")) - 1)).otherwise(F.array(F.lit(0)))).select(*ident, "token", F.explode("i").alias("i")).withColumn("word", F.get(F.split("token", "-"), F.col("i")))
    hit = parts.join(right, "word")
    ocr = hit.select(*ident, F.lit("ocr").alias("noise"), F.when(F.col("token").contains("-"), F.array_join(F.transform(F.split("token", "-"), lambda x, i: F.when(i == F.col("i"), F.col("right")).otherwise(x)), "-")).otherwise(F.col("right")).alias("fragment"))
    cuts = p.select(*ident, F.explode("breaks").alias("b")).select(*ident, "b.l", "b.r", "b.mark").join(t["whole"], ["l", "r", "mark"]).select(*ident, F.col("joined").alias("word")).join(right, "word", "left")
    hyphen = cuts.select(*ident, F.lit("hyphen").alias("noise"), F.coalesce("right", "word").alias("fragment"))
    lines = furniture(t)
    header = lines.filter("head <> ''").select(*ident, F.lit("header").alias("noise"), F.col("head").alias("fragment"))
    page = lines.filter("page is not null").select(*ident, F.lit("page_number").alias("noise"), F.col("page").alias("fragment"))
    return ocr.unionByName(hyphen).unionByName(header).unionByName(page).distinct()


def _cased(model: str, w: str) -> str:
    return w.upper() if model.isupper() and len(model) > 1 else w.capitalize() if model[:1].isupper() else w


def mend(text: str | None, right: dict[str, str], whole: set[tuple[str, str, str]], gone: set[int]) -> str | None:
    """A record without the lines in gone, the breaks in whole joined, the words in right put right, wrapped lines of a paragraph in one; all else as it is."""
    if not text:
        return text
    p, edits = Page(text), []
    for i in gone:
        end = p.offsets[i + 1] if i + 1 < len(p.lines) else p.offsets[i] + len(p.lines[i])
        # The last line takes the line feed before it along.
        start = p.offsets[i] - (i + 1 == len(p.lines) and i > 0)
        if end > start:
            edits.append((*p.place(start, end), ""))
    joined = set()
    for left, r, mark, a, b in p.breaks:
        if (left, r, mark) in whole:
            edits.append((*p.place(a, b), ""))
            joined.add(a)
            if new := right.get(left + r):
                # The whole word is misread: it stands anew over both halves.
                first = a - len(re.search(r"[^\W_]*$", p.text[:a])[0])
                last = b + len(re.match(r"[^\W_]*", p.text[b:])[0])
                edits[-1] = (*p.place(first, last), _cased(p.text[first:a], new))
    for w, a, b in p.words:
        if w in right:
            edits.append((*p.place(a, b), _cased(p.text[a:b], right[w])))
        elif "-" in w:
            at = a
            for part in w.split("-"):
                if part in right:
                    edits.append((*p.place(at, at + len(part)), _cased(p.text[at : at + len(part)], right[part])))
                at += len(part) + 1
    kept = [i for i in range(len(p.lines)) if i not in gone and p.bare[i]]
    for i, j in zip(kept, kept[1:]):
        x, y, end = p.bare[i], p.bare[j], p.offsets[i] + len(p.lines[i].rstrip())
        low, between = y[:1].islower(), any(k not in gone for k in range(i + 1, j))
        if i in p.fenced or j in p.fenced or _MARKUP.search(x) or _MARKUP.search(y) or _CAPTION.match(x) or _CAPTION.match(y) or end - 1 in joined:
            continue
        if (j == i + 1 and len(x) > 40 and (low or not _END.search(x))) or (j > i + 1 and low and not _END.search(x) and (not between or any(k in gone for k in range(i + 1, j)))):
            edits.append((*p.place(end, p.offsets[j] + p.lines[j].index(y)), " "))
    out, at = [], 0
    # Of edits that overlap the longer one holds; it takes the shorter one in.
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a >= at:
            out += [text[at:a], new]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def repaired(chunks: DataFrame, audit: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record_kind, record_key, text, repaired): each distinct record with its text as continuous paragraphs."""
    rows = identified(records(chunks, audit))
    t = analyse(rows, audit, catalog)
    p = t["parsed"]
    tokens = F.array_distinct(F.concat(F.flatten(F.transform("words", lambda w: F.split(w, "-"))), F.transform("breaks", lambda b: F.concat(b["l"], b["r"]))))
    fixes = p.select("rid", F.explode(tokens).alias("word")).join(t["right"], "word").groupBy("rid").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("right"))
    wholes = p.select("rid", F.explode("breaks").alias("b")).select("rid", "b.l", "b.r", "b.mark").join(t["whole"], ["l", "r", "mark"]).groupBy("rid").agg(F.collect_set(F.struct("l", "r", "mark")).alias("whole"))
    gone = furniture(t).groupBy("rid").agg(F.collect_set("at").alias("gone"))
    joined = rows.select("rid", "record_kind", "record_key", "text").join(fixes, "rid", "left").join(wholes, "rid", "left").join(gone, "rid", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fixed = [mend(x, dict(r) if r is not None else {}, {(w["l"], w["r"], w["mark"]) for w in ws} if ws is not None else set(), set(map(int, g)) if g is not None else set()) for x, r, ws, g in zip(b.text, b.right, b.whole, b.gone)]
            yield pd.DataFrame({"record_kind": b.record_kind, "record_key": b.record_key, "text": b.text, "repaired": pd.Series(fixed, index=b.index, dtype=object)})

    return joined.mapInPandas(run, "record_kind string, record_key string, text string, repaired string")
