"""Token counts by partitioned prefix tries, and token budgets a slice.

Texts are cut into pieces by the tokenizer's pattern; the distinct pieces are range-partitioned and sorted, so that each partition is a walk over a prefix
trie. At every byte of a piece the state is the last token of the byte-pair encoding of the prefix so far and the number of
tokens; states along a prefix that two neighbouring pieces share are carried over. A token may end a prefix if it forms
a pair with the last token before it that the merges themselves would leave as it is; exactly one does. The counts
at the ends of pieces are joined back to the documents.

The BROADCAST most frequent pieces are broadcast; what a text holds besides them, rare pieces by their nature, is joined by a shuffle, so that neither a hot
piece nor the size of the vocabulary harms. Defined results: null and empty texts have 0 tokens; bytes outside the vocabulary count one token
each; rows that are equal in all columns, text included, count once.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.session import cut, fine

#: Rank file of the default tokenizer, and the pattern that cuts text for it; both are parameters.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that are broadcast at most.
BROADCAST = 300_000


def load(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Walk:
    """Encoding states along the prefixes of sorted pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=1)
        self.piece = b""
        #: Per prefix length: start of its last token and number of tokens.
        self.start, self.count = [0], [0]
        self.pair = lru_cache(500_000)(self._pair)

    def merged(self, text: bytes) -> list[bytes]:
        """Byte-pair encoding of a short string by its merges."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1)]
            best = min(((r, i) for r, i in ranked if r is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _pair(self, left: bytes, right: bytes) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def tokens(self, piece: bytes) -> int:
        """Number of tokens of a piece; the states of the prefix shared with the piece before are kept."""
        if piece in self.ranks:
            return 1
        keep, top = 0, min(len(piece), len(self.piece))
        while keep < top and piece[keep] == self.piece[keep]:
            keep += 1
        del self.start[keep + 1 :], self.count[keep + 1 :]
        self.piece = piece
        for end in range(keep + 1, len(piece) + 1):
            at, n = end - 1, self.count[end - 1] + 1
            for begin in range(max(0, end - self.longest), end):
                token = piece[begin:end]
                if token in self.ranks and self.pair(piece[self.start[begin] : begin], token):
                    at, n = begin, self.count[begin] + 1
                    break
            self.start.append(at)
            self.count.append(n)
        return self.count[len(piece)]


def _pieces(text: str | None, pattern) -> list[str]:
    return pattern.findall(text) if text else []


def piece_counts(texts: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """(piece, times, n): occurrences (in as many batches as sent it) and tokens of each distinct piece of column text."""
    held = texts.sparkSession.sparkContext.broadcast(ranks)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        p = regex.compile(pattern)
        for b in batches:
            n = Counter(x for t in b.text for x in _pieces(t, p))
            yield pd.DataFrame({"piece": list(n), "times": list(n.values())}).astype({"piece": object, "times": "int64"})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Walk(held.value)
        for b in batches:
            yield pd.DataFrame({"piece": b.piece, "times": b.times, "n": [w.tokens(x.encode()) for x in b.piece]})

    pieces = cut(fine(texts.select("text")).mapInPandas(distinct, "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times")))
    return cut(pieces.repartitionByRange("piece").sortWithinPartitions("piece").mapInPandas(walk, "piece string, times long, n long"))


def counted(texts: DataFrame, columns: list[str], path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Distinct rows (columns, n_tokens) of texts; columns are those to carry along beside the text, others are not read."""
    rows = texts.select(*columns, "text")
    table = piece_counts(rows, load(path), pattern)
    top = table.orderBy(F.desc("times"), "piece").limit(BROADCAST).select("piece", "n").toPandas()
    known = rows.sparkSession.sparkContext.broadcast(dict(zip(top.piece, top.n.tolist())))
    whole = table.count() <= BROADCAST
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in columns) + "digest string, n_tokens long, rest array<struct<piece:string,times:long>>"

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        p, table = regex.compile(pattern), known.value
        for b in batches:
            out, sums, rest, digests = b[columns].copy(), [], [], []
            for t in b.text:
                n, more = 0, Counter()
                for x in _pieces(t, p):
                    k = table.get(x)
                    if k is None:
                        more[x] += 1
                    else:
                        n += k
                sums.append(n)
                rest.append([{"piece": x, "times": k} for x, k in more.items()])
                digests.append(None if t is None else hashlib.md5(t.encode()).hexdigest())
            out["digest"], out["n_tokens"], out["rest"] = pd.Series(digests, index=b.index, dtype=object), sums, rest
            yield out

    each = fine(rows).mapInPandas(total, schema)
    if whole:
        return each.select(*columns, "digest", "n_tokens").distinct().drop("digest")
    each = cut(each)
    open_ = each.filter(F.size("rest") > 0).dropDuplicates(["digest"]).select("digest", F.explode("rest").alias("r")).select("digest", "r.piece", "r.times")
    more = open_.join(table.select("piece", "n"), "piece").groupBy("digest").agg(F.sum(F.col("times") * F.col("n")).alias("more"))
    done = each.select(*columns, "digest", "n_tokens").distinct().join(more, "digest", "left")
    return done.select(*columns, (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def last_counts(tokenized: DataFrame) -> DataFrame:
    """(chunk_id, o200k, bge): the latest count above 0 of each chunk, by tokenizer."""
    def latest(c: str):
        return F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, F.struct("counted_at", c)))

    return tokenized.groupBy("chunk_id").agg(latest("o200k_tokens").alias("o200k"), latest("bge_tokens").alias("bge"))


def script(text):
    """Language group of a text by its letters, for rows without lang."""
    return F.when(F.length(F.regexp_replace(text, r"[^\p{IsCyrillic}]", "")) * 2 > F.length(F.regexp_replace(text, r"[^\p{L}]", "")), "ru").when(text.rlike(r"(?i)\b(?:der|die|das|und|wurde)\b"), "de").otherwise("en")


def ratios(chunks: DataFrame, tokenized: DataFrame, path: str = RANKS) -> DataFrame:
    """(lang, o200k_ratio, bge_ratio): tokens of the two counts for one token of the public tokenizer, over all chunks with counts; lang null: over all languages."""
    own = chunks.filter("text is not null").groupBy("chunk_id").agg(F.max(F.struct("text", "lang")).alias("x")).select("chunk_id", "x.text", F.coalesce("x.lang", script(F.col("x.text"))).alias("lang"))
    joined = counted(cut(own), ["chunk_id", "lang"], path).join(last_counts(tokenized), "chunk_id")

    def ratio(c: str):
        return (F.sum(c) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_tokens")))).alias(f"{c}_ratio")

    return joined.rollup("lang").agg(ratio("o200k"), ratio("bge"), F.grouping("lang").alias("g")).filter("lang is not null or g = 1").drop("g")


def document_counts(docs: DataFrame, catalog: DataFrame, chunks: DataFrame, tokenized: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens exact, o200k_estimate, bge_estimate). A null lang is that of the book in the catalogue, else of the letters; a null topic that of the book."""
    books = catalog.groupBy("book").agg(F.max(F.struct("lang", "topic", "source")).alias("b")).select("book", F.col("b.lang").alias("b_lang"), F.col("b.topic").alias("b_topic"))
    sized = counted(docs.withColumn("guess", F.coalesce("lang", script(F.col("text")))), ["doc_id", "source", "lang", "topic", "book", "guess"], path)
    known = sized.join(books, "book", "left").select("doc_id", "source", F.coalesce("lang", "b_lang", "guess").alias("lang"), F.coalesce("topic", "b_topic").alias("topic"), "n_tokens")
    # One row a language.
    r = cut(ratios(chunks, tokenized, path))
    overall = r.filter("lang is null").first()
    per = r.filter("lang is not null").select("lang", *[F.col(f"{c}_ratio").alias(c) for c in ("o200k", "bge")])
    out = known.join(F.broadcast(per), "lang", "left")
    estimate = lambda c: F.round(F.col("n_tokens") * F.coalesce(F.col(c), F.lit(overall[f"{c}_ratio"] if overall else None).cast("double"))).cast("long").alias(f"{c}_estimate")
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", estimate("o200k"), estimate("bge"))


def budget(docs: DataFrame, catalog: DataFrame, chunks: DataFrame, tokenized: DataFrame, path: str = RANKS) -> DataFrame:
    """Totals by source, lang, topic and their subtotals (level counts the columns that are rolled up): documents, exact tokens and both estimates."""
    per = document_counts(docs, catalog, chunks, tokenized, path)
    return per.rollup("source", "lang", "topic").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("o200k_estimate").alias("o200k_estimate"), F.sum("bge_estimate").alias("bge_estimate"), (F.grouping("source") + F.grouping("lang") + F.grouping("topic")).cast("int").alias("level"))


def chunk_budget(catalog: DataFrame, chunks: DataFrame, tokenized: DataFrame) -> DataFrame:
    """Totals of the counts that the chunks came with, by source, lang, topic: chunks, chunks with each count, and the sums. Chunks count once; lang null is that of the book."""
    one = chunks.groupBy("chunk_id").agg(F.max("book").alias("book"), F.max("lang").alias("lang"))
    books = catalog.groupBy("book").agg(F.max("lang").alias("b_lang"), F.max("source").alias("source"), F.max("topic").alias("topic"))
    per = one.join(books, "book", "left").join(last_counts(tokenized), "chunk_id", "left").withColumn("lang", F.coalesce("lang", "b_lang"))
    return per.groupBy("source", "lang", "topic").agg(F.count("*").alias("n_chunks"), F.count("o200k").alias("n_o200k"), F.count("bge").alias("n_bge"), F.sum("o200k").alias("o200k_tokens"), F.sum("bge").alias("bge_tokens"))
