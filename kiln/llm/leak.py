"""Evaluation passages in a corpus: Wu-Manber search of many patterns at once.

Patterns are stretches of M folded characters from each word of each test item. A table over hashed blocks of B characters tells
how far a window may move without missing a pattern; where it may not move, a bucket by hash of the window picks the
patterns and direct comparison confirms. Cursors over all stretches of a batch of texts move together. Confirmed
places on one diagonal form runs, runs are lengthened character by character, and the words of an item that lie in runs are
counted: runs of RUN words, and runs of NEAR words within GAP words of such a run.

Items lie in blocks of some BLOCK_CHARS characters by hash. The tables of a block are built on an executor, written, and broadcast one block after another;
with more than one block the documents are folded once and written, so that a block costs a scan of folded text only. Defined results: null and empty
texts hold nothing; an item of fewer than RUN words counts by runs as long as itself; an item whose folded text is shorter than M characters
has no pattern and is never found; repeated documents each count; repeated rows once.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.skeleton import fold, plain
from kiln.session import cut, fine

M, B, TABLE = 16, 4, 1 << 20
RUN, NEAR, GAP = 6, 4, 3
#: Share of an item's words that makes a leak.
SHARE = 0.5
#: Least share that overlaps() gives.
LEAST = 0.2
BLOCK_CHARS = 4_000_000
#: Places that are compared with patterns at once.
SLICE = 1 << 18
#: Characters that one cursor passes.
STRETCH = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def _blocks(c: np.ndarray) -> np.ndarray:
    """Hash of the B characters that end at each place; places before B-1 hold 0."""
    h = np.zeros(len(c), np.uint64)
    for k in range(B):
        x = np.zeros(len(c), np.uint64)
        x[k:] = c[: len(c) - k]
        h = h * np.uint64(1_000_003) + x
    return ((h * _MULT) >> np.uint64(44)).astype(np.int64) & (TABLE - 1)


def _windows(c: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return c[ends[:, None] - np.arange(M - 1, -1, -1)[None, :]]


def _hash(w: np.ndarray) -> np.ndarray:
    h = np.zeros(len(w), np.uint64)
    for k in range(M):
        h = (h ^ w[:, k].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


class Patterns:
    """Shift table and buckets of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.starts, self.chars = [], [], []
        ends, owner, word = [], [], []
        for i, t in items:
            ws = [w for w in (fold(x) for x in plain(t).split()) if w]
            s = np.cumsum([0, *map(len, ws)])
            k = len(self.ids)
            self.ids.append(i)
            self.starts.append(s)
            self.chars.append(_codes("".join(ws)))
            for j in range(len(ws)):
                if s[j] + M <= s[-1]:
                    ends.append(self.chars[k][s[j] : s[j] + M])
                    owner.append(k)
                    word.append(j)
        w = np.array(ends, np.uint32).reshape(-1, M)
        h = _hash(w)
        order = np.argsort(h, kind="stable")
        self.w, self.h, self.owner, self.word = w[order], h[order], np.array(owner, np.int64)[order], np.array(word, np.int64)[order]
        self.shift = np.full(TABLE, M - B + 1, np.int16)
        for j in range(M - 1, B - 2, -1):
            if len(w):
                x = np.zeros(len(w), np.uint64)
                for k in range(B):
                    x = x * np.uint64(1_000_003) + w[:, j - k].astype(np.uint64)
                np.minimum.at(self.shift, ((x * _MULT) >> np.uint64(44)).astype(np.int64) & (TABLE - 1), np.int16(M - 1 - j))

    def search(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place where the window starts, pattern) of each confirmed occurrence in an array of characters."""
        if len(c) < M or not len(self.w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = _blocks(c)
        at = np.arange(M - 1, len(c), STRETCH)
        stop = np.minimum(at + STRETCH, len(c))
        stays = []
        while len(at):
            s = self.shift[block[at]]
            stays.append(at[s == 0])
            at = at + np.maximum(s, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(stays) if stays else np.zeros(0, np.int64)
        w = _windows(c, ends)
        h = _hash(w)
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        met = np.flatnonzero(hi > lo)
        places, patterns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        # A phrase that many items share is a long bucket: places and patterns are compared slice by slice, so that memory is bounded.
        while at < len(met):
            n = (hi - lo)[met[at:]]
            take = max(1, int(np.searchsorted(n.cumsum(), SLICE, "right")))
            part, n = met[at : at + take], n[:take]
            which = np.repeat(part, n)
            pattern = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            same = (w[which] == self.w[pattern]).all(1)
            places.append(ends[which[same]] - (M - 1))
            patterns.append(pattern[same])
            at += take
        return np.concatenate(places), np.concatenate(patterns)

    def coverage(self, k: int, hits: list[tuple[int, int]], c: np.ndarray) -> float:
        """Share of the words of item k that lie in runs of a document c; hits: (place, word)."""
        starts, chars = self.starts[k], self.chars[k]
        diagonals: dict[int, list[int]] = defaultdict(list)
        for p, j in hits:
            diagonals[p - int(starts[j])].append(int(starts[j]))
        runs = []
        for d, offs in diagonals.items():
            offs.sort()
            a, b = offs[0], offs[0] + M
            for o in [*offs[1:], None]:
                if o is not None and o <= b:
                    b = max(b, o + M)
                    continue
                n = min(len(chars) - b, len(c) - (b + d))
                diff = np.flatnonzero(chars[b : b + n] != c[b + d : b + d + n]) if n > 0 else []
                end = b + (int(diff[0]) if len(diff) else max(n, 0))
                first, last = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, end, "right")) - 1
                if last - first >= min(NEAR, len(starts) - 1):
                    runs.append((first, last, a + d))
                if o is not None:
                    a, b = o, o + M
        size = len(starts) - 1
        enough = min(RUN, size)
        counted = [r for r in runs if r[1] - r[0] >= enough]
        rest = [r for r in runs if r[1] - r[0] < enough]
        slack = GAP * 12
        for r in rest:
            place = r[2] + int(starts[r[1]] - starts[r[0]])
            for x in counted:
                after = 0 <= x[0] - r[1] <= GAP and 0 <= x[2] - place <= slack
                before = 0 <= r[0] - x[1] <= GAP and 0 <= r[2] - (x[2] + int(starts[x[1]] - starts[x[0]])) <= slack
                if after or before:
                    counted.append(r)
                    break
        words = np.zeros(size, bool)
        for first, last, _ in counted:
            words[first:last] = True
        return float(words.sum()) / max(size, 1)


def _fold(text: str | None) -> str:
    return fold(plain(text)) if text else ""


def _folded(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with each text as the search sees it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "text": [_fold(t) for t in b.text]})

    return fine(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, text string")


def _block_leaks(docs: DataFrame, held: Broadcast, seen: Callable[[str | None], str]) -> DataFrame:
    """(doc_id, item_id, share) of one block of items; seen brings a text of docs to the form of the search."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns: Patterns = held.value
        gap = np.zeros(1, np.uint32)
        for b in batches:
            texts = [_codes(seen(t)) for t in b.text]
            joined = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
            first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            place, pattern = patterns.search(joined)
            by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            doc = np.searchsorted(first, place, "right") - 1
            for d, p, k, j in zip(doc.tolist(), (place - first[doc]).tolist(), patterns.owner[pattern].tolist(), patterns.word[pattern].tolist()):
                by[d, k].append((p, j))
            out = [(b.doc_id.iloc[d], patterns.ids[k], share) for (d, k), hits in by.items() if (share := patterns.coverage(k, hits, texts[d])) >= LEAST]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

    return docs.mapInPandas(run, "doc_id long, item_id long, share double")


def blocks(items: DataFrame) -> DataFrame:
    """(block, tables): the pickled search tables of each block of items."""
    rows = items.select("item_id", "item_text").filter("item_text is not null").distinct()
    n = int((rows.agg(F.sum(F.length("item_text"))).first()[0] or 0) // BLOCK_CHARS) + 1

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "item_text"])
        return pd.DataFrame({"block": pdf.block.iloc[:1], "tables": [pickle.dumps(Patterns(list(zip(pdf.item_id, pdf.item_text))))]})

    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n))).groupBy("block").applyInPandas(build, "block long, tables binary")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): documents that hold LEAST of an item's words or more. docs: doc_id, text; items: item_id, item_text."""
    spark, tables = docs.sparkSession, cut(blocks(items))
    numbers = sorted(r.block for r in tables.select("block").collect())
    rows, seen, out = (fine(docs.select("doc_id", "text")), _fold, None) if len(numbers) <= 1 else (cut(_folded(docs)), str, None)
    for k in numbers:
        held = spark.sparkContext.broadcast(pickle.loads(tables.filter(F.col("block") == k).first().tables))
        part = _block_leaks(rows, held, seen)
        # With several blocks each is searched before the next is held.
        if len(numbers) > 1:
            part = cut(part)
            held.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, share double")
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each leak."""
    return overlaps(docs, items).filter(F.col("share") >= SHARE).select("doc_id", "item_id")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that hold it and the largest share; items that leaked nowhere have 0 documents."""
    leaks = overlaps(docs, items).filter(F.col("share") >= SHARE).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("top_share"))
    return items.select("item_id", "item_kind").distinct().join(leaks, "item_id", "left").select("item_id", "item_kind", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.round("top_share", 4).alias("top_share"))
