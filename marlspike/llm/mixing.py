"""Mixing sources to target weights by Sainte-Laguë apportionment.

A document's size is its number of words.  Sources in code point order (null last)
have weights 5, 2, 1, repeating, and share ``share`` times all words; a target stops
at ``repeat`` times its source's size and the excess is shared again by weight.

Targets are then met in equal blocks of ``block_words`` words, or fewer, so that the
smallest target has ``LEAST_BLOCKS`` at least (a block has one word at least).  Seats
(blocks) go to the sources by the highest quotients votes / (2 seats + 1), with the targets
as votes; a source's seats go to its shards the same way, with the shards' sizes as
votes.  Where seats come to more than ``repeat`` times a size, the words above it are
given out again among the others.  Each shard's quota of words is laid over its documents in a seeded order: as
many whole passes as fit, then blocks from the front of that order, so the last
document may be taken in part.

Defined results: null and empty texts have size 0 and are taken 0 times; a source of
size 0 has target 0; repeated rows are documents of their own; reruns agree, because
the order is a hash of seed, id and text; extra columns are ignored.

Scale: texts are read once and only sizes and hashes go on.  A shard has about
``shard_docs`` documents, so a source with a third of all rows is spread over as many
shards as its rows need, and so is an id that many texts share.  A source has
``max_shards`` shards at most, because one task gives them their quotas; beyond that
its shards have more documents.  Only the table of sources (``max_sources`` rows at
most, counted first) reaches the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK_WORDS = 64
LEAST_BLOCKS = 64
SHARD_DOCS = 1000
MAX_SHARDS = 100_000
SEED = 17
MAX_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 seats + 1); ties go to the earlier party.

    Rounded shares are the apportionment of some number of seats near ``seats``; from
    there seats are added or taken back one by one, so the cost does not grow with
    the number of seats.
    """
    votes = np.asarray(votes, dtype=np.float64)
    out = np.zeros(len(votes), np.int64)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return out
    out = np.floor(votes * (seats / total) + 0.5).astype(np.int64)
    short = seats - int(out.sum())
    if short > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out)) if v > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif short < 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, out)) if s > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            i = -heap[0][1]
            out[i] -= 1
            if out[i] > 0:
                heapq.heapreplace(heap, (votes[i] / (2 * out[i] - 1), -i))
            else:
                heapq.heappop(heap)
    return out


def quotas(votes, caps, words: int, block: int) -> np.ndarray:
    """``words`` shared out in blocks by Sainte-Laguë, no party above its cap; what a cap cuts off is shared out again."""
    votes, caps = np.asarray(votes, dtype=np.float64), np.asarray(caps, dtype=np.int64)
    out, open_ = np.zeros(len(votes), np.int64), np.flatnonzero(votes > 0)
    while len(open_):
        given = sainte_lague(votes[open_], (words + block // 2) // block) * block
        over = given > caps[open_]
        if not over.any():
            out[open_] = given
            break
        out[open_[over]] = caps[open_[over]]
        words = max(0, words - int(caps[open_[over]].sum()))
        open_ = open_[~over]
    return out


def block_size(goal: list[float], block_words: int) -> int:
    """Words of a block: few enough that the smallest target that is not 0 has ``LEAST_BLOCKS``, one at least."""
    least = min((g for g in goal if g > 0), default=0.0)
    return max(1, min(block_words, int(least // LEAST_BLOCKS)))


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeat: int = REPEAT) -> list[float]:
    """Targets by weight, none above ``repeat`` times its size; the excess is shared again."""
    out = [0.0] * len(sizes)
    left = share * sum(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > repeat * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
        left -= sum(repeat * sizes[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def word_count(text):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shards_for(docs: int, shard_docs: int = SHARD_DOCS, max_shards: int = MAX_SHARDS) -> int:
    """How many shards a source of ``docs`` documents has."""
    return -(-docs // max(shard_docs, -(-docs // max_shards)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, max_sources: int = MAX_SOURCES, max_shards: int = MAX_SHARDS) -> DataFrame:
    """One row for each document: id, size, source_size, target of its source, taken words, shard."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("mark")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, repeat)
    block = block_size(goal, block_words)
    words = quotas(goal, [repeat * n for n in sizes], round(sum(goal)), block)
    plan = pd.DataFrame({"source": [r["source"] for r in found], "sid": range(len(found)), "source_size": sizes, "target": goal, "words": [int(x) for x in words], "shards": [shards_for(r["n"], shard_docs, max_shards) for r in found]})
    sources = spark.createDataFrame([tuple(x) for x in plan.astype(object).itertuples(index=False)], "source string, sid int, source_size long, target double, words long, shards long")
    dealt = (
        sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"]))
        .select("doc_id", "size", "sid", "source_size", "target", "words", "mark", F.xxhash64(F.lit(seed), "doc_id", "mark").alias("_h"), "shards")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), F.col("shards")))
    )
    shards = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("words").alias("words"))

    def quota(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        words = quotas(pdf["shard_size"], repeat * pdf["shard_size"], int(pdf["words"].iloc[0]), block)
        return pd.DataFrame({"sid": pdf["sid"], "shard": pdf["shard"], "shard_size": pdf["shard_size"], "quota": words})

    shares = shards.groupBy("sid").applyInPandas(quota, "sid int, shard long, shard_size long, quota long")
    order = Window.partitionBy("sid", "shard").orderBy("_h", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.join(shares, ["sid", "shard"]).withColumn("_before", F.sum("size").over(order) - F.col("size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.expr("quota div nullif(shard_size, 0)"))).otherwise(F.lit(0))
    rest = F.col("quota") - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return laid.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), "shard")


def op3(spark, sf_dir: str) -> DataFrame:
    """``op3_mix_sources`` over all of ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: the mix over what the earlier stages kept.

    One row for each document, with null and empty texts of size 0, repeated rows as
    documents of their own, and null as the last source; other columns do not come back.
    """
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
