"""Measured quantities brought to one unit each.

A text yields observations: a number with the unit beside it, or a bare number in a sentence about a quantity, with or without a unit that the chunk announces.
All observations of one device (book and series) form a sequence in the order of the book. The unit is the hidden state of a hidden
Markov model: a written unit is right but for a misprint (MISPRINT), an announced one but for a slip (SLIP), units switch with SWITCH,
and the log of the converted value is drawn about a smooth level of the device, estimated from the data. Viterbi decodes the units, so a
value far off the level under its written unit takes the unit that fits, and bare numbers take theirs from the level alone.

A book is scanned in stretches; each sums up as the least cost from every unit at its start to every unit at its end, the summaries are
chained over the book, and each stretch is decoded between the units it begins and ends with: the result does not depend on STRETCH but for the level.

Defined results: null or empty text gives no rows; repeated rows count once; rows of a null book are one device; a chunk without a position is a sequence
of its own. ``normalize`` holds every number read, ``found`` those whose unit stands beside them or in their chunk.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.session import clustered, cut, fine, groups

#: Characters of a book that one task decodes, and over which the level is one.
STRETCH = 200_000

INCH, KGF, PSI, FT_LBF = 25_400.0, 9.80665, 0.00689475729, 1.35581795
DEG = {"K": 1.0, "C": 1.0, "F": 5 / 9}
TIME = {"s": 60.0, "min": 1.0, "h": 1 / 60}

#: unit -> (scale, offset): common = value * scale + offset.
UNITS: dict[str, dict[str, tuple[float, float]]] = {
    "temperature": {"C": (1.0, 0.0), "K": (1.0, -273.15), "F": (5 / 9, -160 / 9)},
    "stress": {"MPa": (1.0, 0.0), "GPa": (1000.0, 0.0), "kgf/mm2": (KGF, 0.0), "psi": (PSI, 0.0), "ksi": (1000 * PSI, 0.0), "Pa": (1e-6, 0.0)},
    "length": {"um": (1.0, 0.0), "mm": (1000.0, 0.0), "cm": (10_000.0, 0.0), "in": (INCH, 0.0), "m": (1e6, 0.0), "nm": (1e-3, 0.0)},
    "cooling_rate": {f"{d}/{t}": (DEG[d] * TIME[t], 0.0) for d in DEG for t in TIME},
    "energy": {"J": (1.0, 0.0), "kJ": (1000.0, 0.0), "kgf*m": (KGF, 0.0), "ft*lbf": (FT_LBF, 0.0)},
    "force": {"kN": (1.0, 0.0), "MN": (1000.0, 0.0), "N": (1e-3, 0.0), "tf": (KGF, 0.0), "kgf": (KGF / 1000, 0.0), "lbf": (0.0044482216, 0.0)},
}

_C = "[CС]"
_DEG_C = rf"°\s?{_C}|deg(?:rees?)?\.?\s+(?:Celsius|centigrade|C)|Grad\s+(?:Celsius|C)|градус\w*(?:\s+(?:Цельсия|{_C}))?|град\.?(?:\s+Цельсия)?"
_DEG_F = r"°\s?F|deg(?:rees?)?\.?\s+(?:Fahrenheit|F)|Grad\s+Fahrenheit|градус\w*\s+Фаренгейта"
_KELVIN = r"[KК]|kelvins?|Kelvin|кельвин\w*"
_PER = r"\s?/\s?|\s+per\s+|\s+a\s+|\s+pro\s+|\s+в\s+"
_TIMES = {"s": r"s(?:ec(?:onds?)?)?|Sekunden?|сек(?:унд\w*)?|с", "min": r"min(?:utes?)?|Minuten?|мин(?:ут\w*)?", "h": r"h(?:ours?|r)?|Stunden?|час\w*|ч"}
_MM2 = r"(?:mm|мм)\s?\^?2|(?:mm|мм)2|square\s+millimet(?:re|er)s?|Quadratmillimeter|квадратн\w+\s+миллиметр\w*"
_DOT = r"\s?[·⋅.*x×-]?\s?"

#: (quantity, unit, pattern), the longest forms first; patterns see text in compatibility form.
_FORMS: list[tuple[str, str, str]] = [
    *(("cooling_rate", f"{d}/{t}", rf"(?:{p})(?:{_PER})(?:{q})") for d, p in (("F", _DEG_F), ("C", _DEG_C + rf"|{_C}"), ("K", _KELVIN)) for t, q in _TIMES.items()),
    ("stress", "kgf/mm2", rf"(?:kgf|kg|kp|кгс|кГ|кг|kilograms?[- ]force|Kilopond|килограмм-сил\w*)(?:{_PER}|\s+на\s+)(?:{_MM2})"),
    ("stress", "MPa", rf"MPa|МПа|megapascals?|Megapascal|мегапаскал\w*|(?:MN|МН)(?:{_PER})(?:m|м)\s?2|(?:N|Н|newtons?|Newton|ньютон\w*)(?:{_PER}|\s+на\s+)(?:{_MM2})"),
    ("stress", "GPa", r"GPa|ГПа|gigapascals?|Gigapascal|гигапаскал\w*"),
    ("stress", "ksi", r"ksi"),
    ("stress", "psi", r"psi|pounds?\s+per\s+square\s+inch"),
    ("energy", "kgf*m", rf"(?:kgf|kg|kp|кгс|кГ|кг){_DOT}(?:m|м)"),
    ("energy", "ft*lbf", rf"(?:ft|foot|feet){_DOT}(?:lbf?s?|pounds?(?:-force)?)"),
    ("energy", "kJ", r"kJ|кДж|kilojoules?"),
    ("energy", "J", r"J|Дж|joules?|Joule|джоул\w*"),
    ("force", "kN", r"kN|кН|kilonewtons?|Kilonewton|килоньютон\w*"),
    ("force", "MN", r"MN|МН|meganewtons?|Meganewton|меганьютон\w*"),
    ("force", "tf", r"tf|тс|tons?[- ]force|tonnes?[- ]force|тонн\w*-сил\w*|Tonnen-Kraft"),
    ("force", "kgf", r"kgf|кгс"),
    ("force", "lbf", r"lbf"),
    ("temperature", "F", rf"{_DEG_F}|F"),
    ("temperature", "C", rf"{_DEG_C}|{_C}"),
    ("temperature", "K", _KELVIN),
    ("length", "um", r"[μµu]m|мкм|microns?|micromet(?:re|er)s?|Mikrometer|микрон\w*|микрометр\w*"),
    ("length", "nm", r"nm|нм"),
    ("length", "mm", r"mm|мм|millimet(?:re|er)s?|Millimeter|миллиметр\w*"),
    ("length", "cm", r"cm|см|centimet(?:re|er)s?|Zentimeter|сантиметр\w*"),
    ("length", "in", r"-?inch(?:es)?|Zoll|дюйм\w*|in(?=\s+(?:long|across|wide|thick|high|deep|and|to)\b|[.,;:)]|\s*(?:[|&]|</t)|\s*$)"),
]
_UNIT = "|".join(f"(?P<u{i}>{p})" for i, (_, _, p) in enumerate(_FORMS))
_NUM = r"\d{1,3}(?: \d{3})+(?:[.,]\d+)?|\d{1,3}(?:[.,]\d{3})+(?![\d])|\d+(?:[.,]\d+)?"
_SEP = r"\s?[–—−-]\s?|\s+(?:and then|and|to|or|bis(?: zu)?|und dann|und|до|и затем|и)\s+|\s?(?:\.\.\.|…)\s?"
_VALUE = re.compile(
    rf"(?<![\w.,/\\-])(?:(?P<a>{_NUM})(?:°)?(?P<sep>{_SEP}))?(?P<b>{_NUM})\s{{0,2}}(?:{_UNIT})(?![\w])(?!\s?/\s?[\wа-я])(?!-[A-Za-zА-я])"
)
#: A table row whose label names the unit of its cells: pipes, wiki and LaTeX cells, HTML cells.
_CELL = r"[^\S\n]*(?:\|\|?|&|</t[dh]>\s*<t[dh][^>]*>)[^\S\n]*"
_ROW = re.compile(rf"[,(\[]\s*(?:{_UNIT})[)\]]?(?P<cells>(?:{_CELL}(?:{_NUM}|[-–—]?(?=\s*[|&<])))+)")
_CELL_RE, _NUM_RE = re.compile(_CELL), re.compile(_NUM)
_BARE = re.compile(rf"(?<![\w.,/\\\[(#§-])(?<!\d )(?P<b>{_NUM})(?![\w%\]°])(?![.,]\d)(?!-[\w])")

#: Names of quantities, for announcements and for sentences with bare numbers.
_NAMES = {
    "temperature": r"temperatur|температур",
    "stress": r"strength|stress|прочност|напряжен|текучест|сопротивлен|festigkeit|spannung|streckgrenze",
    "length": r"dimension|length|thickness|gauge|width|размер|длин[аыу]|толщин|abmessung|maße|länge|dicke",
    "cooling_rate": r"cooling rate|rates of cooling|скорост\w* охлажд|kühlrate|abkühl|kühlgeschwindigkeit",
    "energy": r"energ|энерги|работ[аыу] удара|kerbschlag|schlagarbeit",
    "force": r"force|load|усили|нагрузк|kr[aä]ft|last\b",
}
_CUES = {
    "temperature": r"temperatur|температур|finished at|left the last stand|soaked at|start setting|закончена при|выдержан при|вышел из клети|fertiggewalzt|gehalten",
    "stress": r"yielded|tensile|proof stress|strength|yield stress|предел текучести|временное сопротивление|прочност|streckgrenze|festigkeit",
    "length": r"rolled to|across|\blong\b|thick|intercept|grains? of|gauge|прокатан на|толщина|размер зерна|gewalzt|korngröße",
    "cooling_rate": r"cooled|a rate|охлаждали|скорость|gekühlt",
    "energy": r"absorbed|impact energy|работа удара|поглотил|nahm",
    "force": r"force|load|усили|walzkraft|kraft",
}
_GRAIN = re.compile(r"grain|intercept|зерн|korn", re.I)
_CUE_RE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_NAME_RE = {k: re.compile(v, re.I) for k, v in _NAMES.items()}
#: A stem of each name above: a sentence without one names no quantity.
_STEMS = "temperatur температур strength stress прочност напряжен текучест сопротивлен festigkeit spannung streckgrenze dimension length thickness gauge width размер длин толщин abmessung maße länge dicke cooling скорост kühl energ энерги работ kerbschlag schlagarbeit force load усили нагрузк kraft kräft last".split()
_SQUARE = re.compile(r"(?:mm|мм)\s?2")
_LEAD = re.compile(r"(?:\b(?:at|to|of|reached|was|measured|absorbed|is|from|rate|and|then|при|составил[аои]?|равн[аоы]|равен|достигло|усилие|на|поглотил[аи]?|скорость|скоростью|до|от|и|затем|bei|auf|mit|von|betrug|nahm|war|bis|dann|und)\s+|[–—−]\s?)$", re.I)
_UNIT_WORD = re.compile(rf"(?<![\w])(?:{_UNIT}|(?P<ux>inch(?:es)?|дюйм\w*|тоннах-силах|градусах))(?![\w])")
_DIGIT = re.compile(r"\d")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁÄÖÜ<\\*|])|\n\s*\n")
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­͏]")
_BREAK = re.compile(r"(?<=[a-zäöüßа-яё])[-¬]\s*\n\s*(?=[a-zäöüßа-яё])")
_TAGS = re.compile(r"<[/!a-zA-Z][^<>\n]*>|\*{1,3}|'{2,5}|\\(?:textbf|textit|emph|text)\{|&nbsp;|~")


_MARKED, _BLANKS = re.compile(r"[<*'\\&~]"), re.compile(r"[^\S\n]+")


def plain(text: str) -> str:
    """Compatibility form without invisible characters, broken words and inline marks; line breaks stay."""
    t = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "\n" in t:
        t = _BREAK.sub("", t)
    if _MARKED.search(t):
        t = _TAGS.sub(lambda m: " " if m[0][0] in "<&~" else "", t)
    return _BLANKS.sub(" ", t)


def number(s: str, decimal_comma: bool) -> float:
    """A numeral as it is written in its language: groups by blank, comma or point, decimals by point or comma."""
    s = s.replace(" ", "")
    for sep, groups in ((",", not decimal_comma), (".", decimal_comma)):
        if sep in s:
            head, *tail = s.split(sep)
            if len(tail) > 1 or (len(tail[0]) == 3 and groups and head != "0"):
                return number(head + "".join(tail), decimal_comma)
            return float(head + "." + tail[0])
    return float(s)


def _comma_language(text: str, lang: str | None) -> bool:
    if lang in ("ru", "de", "en"):
        return lang != "en"
    if re.search(r"[а-яё]{4}", text):
        return True
    return len(re.findall(r"\b(?:der|die|das|und|wurde|gilt|bei)\b", text)) > len(re.findall(r"\b(?:the|and|was|of|is|by)\b", text))


def _unit_of(m: re.Match) -> tuple[str, str] | None:
    for i, (quantity, unit, _) in enumerate(_FORMS):
        if m.group(f"u{i}") is not None:
            return quantity, unit
    x = m.groupdict().get("ux")
    return None if not x else ("length", "in") if x[0] in "iд" else ("force", "tf") if x[0] == "т" else ("temperature", "C")


def observations(text: str | None, lang: str | None) -> list[tuple[int, str, str, float, str | None, str | None]]:
    """(offset, quantity, series, number, stated unit, announced unit) of a text, in order."""
    if not text:
        return []
    t = plain(text)
    comma, out, announced = _comma_language(t, lang), [], {}
    if "|" in text or "&" in text or "<t" in text:
        for m in _ROW.finditer(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text))):
            if u := _unit_of(m):
                out += [(m.start() + i, u[0], u[0], number(x[0], comma), u[1], None) for i, c in enumerate(_CELL_RE.split(m["cells"])) if (x := _NUM_RE.fullmatch(c.strip()))]
    sentences, at = [], 0
    for m in [*_SENTENCE.finditer(t), None]:
        end = m.start() if m else len(t)
        sentences.append((at, t[at:end].replace("\n", " ")))
        at = m.end() if m else end
    for _, s in sentences:
        low = s.lower()
        if any(x in low for x in _STEMS) and not (_DIGIT.search(s) and _DIGIT.search(_SQUARE.sub("", s))):
            for m in _UNIT_WORD.finditer(s):
                u = _unit_of(m)
                if u and _NAME_RE[u[0]].search(s) and len(m[0]) > (1 if u[0] != "temperature" else 0):
                    announced[u[0]] = u[1]
    for start, s in sentences:
        if not _DIGIT.search(s):
            continue
        taken: list[tuple[int, int]] = []
        for m in _VALUE.finditer(s):
            u = _unit_of(m)
            if u is None:
                continue
            series = "grain" if u[0] == "length" and _GRAIN.search(s) else u[0]
            for g in ("a", "b"):
                if m.group(g):
                    out.append((start + m.start(g), u[0], series, number(m.group(g), comma), u[1], None))
            taken.append(m.span())
        for m in _BARE.finditer(s):
            if any(a <= m.start() < b for a, b in taken) or not _LEAD.search(s[: m.start()]):
                continue
            for quantity in [*announced, *(q for q in _CUES if q not in announced)]:
                if _CUE_RE[quantity].search(s):
                    series = "grain" if quantity == "length" and _GRAIN.search(s) else quantity
                    nxt = re.match(rf"(?:{_SEP})({_NUM})(?![\w])", s[m.end() :])
                    out.append((start + m.start(), quantity, series, number(m["b"], comma), None, announced.get(quantity)))
                    if nxt and not _LEAD.search(s[: m.end() + nxt.start(1)]):
                        out.append((start + m.end(), quantity, series, number(nxt[1], comma), None, announced.get(quantity)))
                    break
    return out


#: Probabilities of a misprinted unit, of a value in another unit than its chunk announces, of a switch of unit, and of a value that no level explains (against the peak of the level's density).
MISPRINT, SLIP, SWITCH, STRAY = 1e-4, 5e-3, 0.2, 1e-5
#: Observations that the level of a device weighs against those of a stretch, and that of the series against those of a device.
PULL = 8.0
#: Least spread of the log values about their level.
LEAST_SPREAD = 0.1
_SWITCH = -math.log(SWITCH / (1 - SWITCH))
_DTYPE = "chunk_id string, book string, start_pos long, off int, quantity string, series string, number double, stated int, announced int, logc double"
_KEYS = ("device", "series", "stretch")
_NAME = {q: list(u) for q, u in UNITS.items()}
_CODE = {(q, None): -1 for q in UNITS} | {(q, u): i for q, us in UNITS.items() for i, u in enumerate(us)}


def costs(quantity: str, values: np.ndarray, stated: np.ndarray, announced: np.ndarray, level: float, spread: float) -> np.ndarray:
    """Negative log-probability of each observation under each unit, up to a constant. stated, announced: places of units in UNITS, -1 for none."""
    scale, offset = np.array(list(UNITS[quantity].values())).T
    z = (np.log(np.maximum(values[:, None] * scale + offset, 1e-9)) - level) / spread
    out = -np.log((1 - STRAY) * np.exp(-0.5 * np.minimum(np.abs(z), 30) ** 2) + STRAY)
    for k, p in ((stated, MISPRINT), (np.where(stated < 0, announced, -1), SLIP)):
        rows = np.flatnonzero(k >= 0)
        other = -math.log(p / (len(scale) - 1))
        out[rows] += other
        out[rows, k[rows]] -= other + math.log(1 - p)
    return out


def viterbi(local: np.ndarray, first: int | None = None, last: int | None = None) -> list[int]:
    """States of the least cost for local costs (n x states), with a cost for each switch; first: the state before the sequence, last: its last state."""
    n, states = local.shape
    cost = np.zeros(states) if first is None else np.where(np.arange(states) == first, 0.0, _SWITCH)
    cost, back, all_ = cost + local[0], np.zeros((n, states), np.int16), np.arange(states)
    for t in range(1, n):
        k = int(cost.argmin())
        moved = cost[k] + _SWITCH
        stay = cost <= moved
        back[t] = np.where(stay, all_, k)
        cost = np.where(stay, cost, moved) + local[t]
    k = int(cost.argmin()) if last is None else last
    out = [k]
    for t in range(n - 1, 0, -1):
        k = int(back[t, k])
        out.append(k)
    return out[::-1]


def summed(local: np.ndarray) -> np.ndarray:
    """Least cost of a stretch from each state before it (rows) to each state at its end (columns)."""
    states = local.shape[1]
    d = np.where(np.eye(states, dtype=bool), 0.0, _SWITCH) + local[0]
    for x in local[1:]:
        d = np.minimum(d, d.min(1, keepdims=True) + _SWITCH) + x
    return d


def chained(sums: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of each stretch on the path of least cost through all of them."""
    back = []
    # Before the first observation any state is as likely as any other, and no switch is paid.
    cost = np.min(sums[0], 0)
    for d in sums[1:]:
        total = cost[:, None] + d
        back.append(total.argmin(0))
        cost = total.min(0)
        cost -= cost.min()
    ends = [int(cost.argmin())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return [(ends[i - 1] if i else None, e) for i, e in enumerate(ends)]


def observe(chunks: DataFrame) -> DataFrame:
    """One row per number with or without a unit; logc is the log of the common value under the written or announced unit. chunks: chunk_id, book, lang, start_pos, text; other columns are not read."""

    def log(quantity: str, v: float, unit: str | None) -> float | None:
        if unit is None:
            return None
        scale, offset = UNITS[quantity][unit]
        return math.log(max(v * scale + offset, 1e-9))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, k, p, *o[:4], _CODE[o[1], o[4]], _CODE[o[1], o[5]], log(o[1], o[3], o[4] or o[5])) for c, k, p, g, t in zip(b.chunk_id, b.book, b.start_pos, b.lang, b.text) for o in observations(t, g)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DTYPE.split(", ")])

    cols = chunks.select("chunk_id", "book", F.col("start_pos").cast("long").alias("start_pos"), "lang", "text").filter(F.col("text").rlike(r"\d"))
    return fine(cols).mapInPandas(run, _DTYPE).dropDuplicates()


def levels(seen: DataFrame) -> DataFrame:
    """(device, series, stretch, level, spread, stretches): level of the log values of each stretch, drawn to that of its device, which is drawn to that of the series; sums only, one row a stretch."""
    sums = cut(seen.groupBy(*_KEYS).agg(F.count("logc").alias("n"), F.coalesce(F.sum("logc"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("logc") * F.col("logc")), F.lit(0.0)).alias("q"), F.avg(F.log(F.greatest(F.abs("number"), F.lit(1e-9)))).alias("bare")))
    device = Window.partitionBy("device", "series")
    rows = sums.withColumn("dn", F.sum("n").over(device)).withColumn("ds", F.sum("s").over(device)).withColumn("stretches", F.count("*").over(device))
    within = sums.groupBy("device", "series").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.avg("bare").alias("bare"))
    per = within.groupBy("series").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.when(F.col("n") > 0, F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("rest"), F.avg("bare").alias("bare"))
    # One row a series, of which there are as many as quantities and one.
    per = per.select("series", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.col("bare")).alias("mean"), F.greatest(F.coalesce(F.sqrt(F.greatest(F.col("rest") / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(0.0))), F.lit(0.0)), F.lit(LEAST_SPREAD)).alias("spread"))
    rows = rows.join(F.broadcast(per), "series")
    own = (F.col("ds") + PULL * F.col("mean")) / (F.col("dn") + PULL)
    return rows.select(*_KEYS, ((F.col("s") + PULL * own) / (F.col("n") + PULL)).alias("level"), "spread", "stretches")


def _stretches(b: pd.DataFrame, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first and end of the observations of a stretch in b, their costs) of each group with bounds at; the first row of a group is that of its level."""
    number, stated, announced, quantity = (b[c].to_numpy() for c in ("number", "stated", "announced", "quantity"))
    for i, j in zip(at, at[1:]):
        if j > i + 1:
            part = slice(i + 1, j)
            yield i + 1, j, costs(quantity[i + 1], number[part], stated[part].astype(int), announced[part].astype(int), float(b.level.iloc[i]), float(b.spread.iloc[i]))


def normalize(chunks: DataFrame) -> DataFrame:
    """Every number of chunks.text that is measured, in the common unit: chunk_id, book, quantity, number, written (the unit beside it, else the announced one), unit (decoded), evidence (stated, announced, level), common_value (double)."""
    # A chunk without a position stands nowhere in its book.
    stretch = F.coalesce(F.floor(F.col("start_pos") / STRETCH), -1 - F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40)))
    seen = cut(observe(chunks).withColumn("stretch", stretch).withColumn("device", F.coalesce(F.concat(F.lit("="), "book"), F.lit(""))))
    level = cut(levels(seen))
    order = ("start_pos", "chunk_id", "off", "number")

    def headed(heads: DataFrame, rows: DataFrame) -> DataFrame:
        """Observations with the row of their stretch before them: one shuffle, no join. Nulls come first."""
        return clustered(rows.unionByName(heads, allowMissingColumns=True), _KEYS, ("head", *order))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, at in groups(batches, _KEYS):
            yield pd.DataFrame([(b.device.iloc[i], b.series.iloc[i], b.stretch.iloc[i], summed(local).ravel()) for i, _, local in _stretches(b, at)], columns=[*_KEYS, "costs"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        side = math.isqrt(len(pdf.costs.iloc[0]))
        path = chained([np.asarray(c).reshape(side, side) for c in pdf.costs])
        return pdf[[*_KEYS]].assign(first=[-1 if x is None else x for x, _ in path], last=[y for _, y in path])

    # Books of one stretch need no chain; a stretch of a chunk without a position follows nothing.
    rows = seen.withColumn("head", F.lit(1))
    several = level.filter("stretches > 1 and stretch >= 0").withColumn("head", F.lit(0))
    long = headed(several, rows.join(several.select(*_KEYS), [*_KEYS], "left_semi")).mapInPandas(summary, "device string, series string, stretch long, costs array<double>")
    ends = long.groupBy("device", "series").applyInPandas(chain, "device string, series string, stretch long, first int, last int")
    heads = level.withColumn("head", F.lit(0)).join(ends, [*_KEYS], "left")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, at in groups(batches, _KEYS):
            path, mine = np.zeros(len(b), int), np.zeros(len(b), bool)
            for i, j, local in _stretches(b, at):
                first, last = b["first"].iloc[i - 1], b["last"].iloc[i - 1]
                path[i:j] = viterbi(local, *[None if pd.isna(x) or x < 0 else int(x) for x in (first, last)])
                mine[i:j] = True
            b, path = b[mine], path[mine]
            stated, announced = b.stated.to_numpy().astype(int), b.announced.to_numpy().astype(int)
            written = np.where(stated >= 0, stated, announced)
            quantity, number = b.quantity.to_numpy(), b.number.to_numpy()
            k = np.array([UNITS[q][_NAME[q][i]] for q, i in zip(quantity, path)]).reshape(-1, 2)
            yield pd.DataFrame({
                "chunk_id": b.chunk_id, "book": b.book, "quantity": quantity, "number": number, "written": [_NAME[q][i] if i >= 0 else None for q, i in zip(quantity, written)],
                "unit": [_NAME[q][i] for q, i in zip(quantity, path)], "evidence": np.where(stated >= 0, "stated", np.where(announced >= 0, "announced", "level")), "common_value": number * k[:, 0] + k[:, 1],
            })

    return headed(heads, rows).mapInPandas(decode, "chunk_id string, book string, quantity string, number double, written string, unit string, evidence string, common_value double")


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, quantity, common_value): distinct values whose unit is written beside them or in their chunk, under the decoded unit."""
    return normalize(chunks).filter(F.col("evidence") != "level").select("chunk_id", "quantity", F.round("common_value").cast("long").alias("common_value")).distinct()
