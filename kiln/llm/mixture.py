"""Mixture of sources to target shares of tokens.

Tokens are summed a source; the total is the target size if one is given, else the largest at which no source is repeated more than its cap; the rate of a source is its
share of that total over its tokens, at most its cap, so that beyond the largest such size scarce sources fall short of their share and the attained shares say by how much. Each document comes floor(rate) times and once more with the fraction as probability,
drawn from a seeded hash of its id, so that a rerun gives the same mixture.

Defined results: sources without target, with share 0 or without tokens are left out and the shares of the rest are scaled to sum to 1; a null
source or cap is no target; repeated target rows count once; an empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kiln.llm.tokens import RANKS, counted
from kiln.session import cut

SEED = 17


def _sized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens), written once."""
    return cut(counted(docs, ["doc_id", "source"], path))


def _over_all() -> WindowSpec:
    """All rows of a table of one row a source."""
    return Window.partitionBy(F.lit(1))


def rates(sized: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """(source, share scaled, tokens, max_repeats, rate): one row a source that can be mixed; size: tokens of the mixture."""
    want = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0")
    both = want.join(have, "source").withColumn("share", F.col("share") / F.sum("share").over(_over_all()))
    total = F.lit(float(size)) if size is not None else F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(_over_all())
    return both.select("source", "share", "tokens", "docs", "max_repeats", F.least(F.col("max_repeats").cast("double"), F.col("share") * total / F.col("tokens")).alias("rate"))


def copies(sized: DataFrame, per_source: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document comes; 0 copies are left out."""
    rows = sized.join(per_source.select("source", "rate"), "source")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    fraction = F.col("rate") - F.floor("rate")
    n = F.floor("rate").cast("int") + (draw < fraction).cast("int")
    return rows.withColumn("copies", n).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mixture(docs: DataFrame, targets: DataFrame, path: str = RANKS, seed: int = SEED, size: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copy): the mixture, one row for each copy of a document."""
    sized = _sized(docs, path)
    return copies(sized, cut(rates(sized, targets, size)), seed).select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def shares(docs: DataFrame, targets: DataFrame, path: str = RANKS, seed: int = SEED, size: int | None = None) -> DataFrame:
    """Per source: target and attained share of tokens, rate, cap, tokens before and after, largest number of copies."""
    sized = _sized(docs, path)
    per = cut(rates(sized, targets, size))
    used = copies(sized, per, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_out"), F.max("copies").alias("most_copies"))
    rows = per.join(used, "source", "left").withColumn("tokens_out", F.coalesce("tokens_out", F.lit(0)))
    attained = F.col("tokens_out") / F.sum("tokens_out").over(_over_all())
    return rows.select("source", F.col("share").alias("target_share"), attained.alias("attained_share"), "rate", "max_repeats", F.col("tokens").alias("tokens_in"), "tokens_out", "most_copies")
