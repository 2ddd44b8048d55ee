"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z in lower case, words are runs without ASCII white space, shingles
of four words joined by a space (repeats included; fewer words: the whole sequence;
none: fingerprint 0), XXH64 with seed 42 of each; a bit is 1 if it is set in over
half of the hashes.

Links: a fingerprint is cut into ``m`` segments.  Two fingerprints within ``radius``
bits agree in at least one segment up to ``radius // m`` bits, so each fingerprint
enumerates the Hamming ball of that radius in every segment, looks those values up
in the segment's table and verifies the complete distance.  ``m`` is chosen by
expected probes and matches at the number of fingerprints; every choice is exact.

A table is dealt out by the high bits of its segments, into as many parts as the
fingerprints need.  Balls in the low bits are enumerated where the table lies; only
flips of high bits send a fingerprint to another part.  The probes of a part with more
than ``HEAVY_ROWS`` rows are dealt out again, each share with the whole table of the
part.  Within a share, links go straight into a union-find and leave as one edge for
each member, so a group of n near copies gives n - 1 edges, not n * n; where a probe
meets many entries, those of its own group so far are skipped.

Groups are the connected components of all links (large-star / small-star over the
edges, each round written to the shared folder until nothing changes; an error if
that takes more than ``rounds``).

Defined results: null and empty texts have fingerprint 0, which links like any other;
rows with equal fingerprints are one node; a null id never names a component unless
all ids in it are null; extra columns are ignored, whatever their names.

Scale: texts never move.  Equal fingerprints collapse by partial aggregation before
any search, so groups of exact copies cost one node.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, drop, free, output, quoted, tidy, written

RADIUS = 4
SHINGLE = 4
PART_ROWS = 4000
HEAVY_ROWS = 200_000
HEAVY_PARTS = 100_000
PAIRS_AT_ONCE = 1 << 20
PIVOTS = 32
DENSE = 256
SENT_COST = 1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each byte value, its bits spread over eight lanes of eight bits, highest bit in the first lane.
_LANES = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64).ravel()


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, in order."""
    from xxhash import xxh64_intdigest as digest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - n].tolist()]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    cells = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    lanes = _LANES[cells]
    counts = np.zeros((8, 8), np.int64)
    for k in range(0, n, 255):  # a lane holds counts up to 255
        counts += lanes[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(8, 8)
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp is the unsigned fingerprint's bits as a signed long."""

    def read(batches):
        for batch in batches:
            found = [fingerprint(shingle_hashes(t or b"")) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(tidy(read), output(docs, {id_col: id_col}, "fp bigint"))


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m nearly equal segments of 64 bits."""
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def prefix_bits(n: int, width: int, part_rows: int = PART_ROWS) -> int:
    """High bits of a segment by which n fingerprints are dealt into parts."""
    return min(width, max(4, round(log2(max(1, n / part_rows))) + 2))


def tables_for(n: int, radius: int = RADIUS) -> int:
    """Number of segments with the least expected cost of probes, matches and fingerprints sent, for n fingerprints."""

    def balls(bits: int, most: int) -> int:
        return sum(comb(bits, k) for k in range(most + 1))

    def cost(m: int) -> float:
        most = radius // m
        return sum(balls(w, most) * (1 + n / 2**w) + SENT_COST * balls(prefix_bits(n, w), most) for _, w in segments(m))

    return min(range(1 + (radius > 1), radius + 2), key=cost)


def masks(low: int, high: int, most: int) -> list[int]:
    """All masks over bits [low, high) with at most ``most`` bits."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(low, high), k)]


class Links:
    """Union-find over positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            np.minimum.at(self.label, high, low)
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


class Pairs:
    """Probes and the ranges [lo, hi) of a sorted table that they meet, verified a block at a time."""

    def __init__(self, fp: np.ndarray, links: Links, radius: int):
        self.fp, self.links, self.radius = fp, links, radius

    def verify(self, probes: np.ndarray, table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Link each probe with the entries table[lo:hi] within the radius."""
        n = hi - lo
        done = np.concatenate(([0], np.cumsum(n)))
        at = 0
        while at < len(probes):
            upto = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
            k = n[at:upto]
            a = np.repeat(probes[at:upto], k)
            b = table[np.repeat(lo[at:upto] - done[at:upto] + done[at], k) + np.arange(done[upto] - done[at])]
            near = np.bitwise_count(self.fp[a] ^ self.fp[b]) <= self.radius
            self.links.add(a[near], b[near])
            at = upto

    def dense(self, probes: np.ndarray, home: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The same for long ranges: first against a few entries of each, then only against entries of other groups.

        ``values`` are the table's sorted values; a range is all entries of one value.
        """
        for k in range(PIVOTS):
            b = home[lo + (hi - lo) * k // PIVOTS]
            near = np.bitwise_count(self.fp[probes] ^ self.fp[b]) <= self.radius
            self.links.add(probes[near], b[near])
        run = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
        while len(probes):
            label = self.links.label
            table = home[np.lexsort((label[home], run))]  # within each range, groups one after another
            key = run * len(label) + label[table]
            own = run[lo] * len(label) + label[probes]
            a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            others = (a - lo) + (hi - b)
            left = others > 0
            probes, lo, hi, a, b, others = (x[left] for x in (probes, lo, hi, a, b, others))
            upto = int(np.searchsorted(np.cumsum(others), 16 * len(home) + PAIRS_AT_ONCE, "right")) + 1
            self.verify(probes[:upto], table, lo[:upto], a[:upto])
            self.verify(probes[:upto], table, b[:upto], hi[:upto])
            probes, lo, hi = probes[upto:], lo[upto:], hi[upto:]


def _part_links(fp: np.ndarray, mask: np.ndarray, probe: np.ndarray, shift: int, width: int, prefix: int, radius: int, most: int) -> np.ndarray:
    """Labels that join linked positions of one share of a part.

    mask: the high bits by which a row was sent here (0: at home, an entry of the table);
    probe: whether the row is looked up in this share.
    """
    seg = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)) ^ mask
    home = np.flatnonzero(mask == 0)
    home = home[np.argsort(seg[home], kind="stable")]
    table = seg[home]
    links = Links(len(fp))
    pairs = Pairs(fp, links, radius)
    weight = np.bitwise_count(mask)
    for flip in masks(0, width - prefix, most):
        probes = np.flatnonzero(probe & (weight + flip.bit_count() <= most))
        value = seg[probes] ^ np.uint64(flip)
        lo, hi = np.searchsorted(table, value, "left"), np.searchsorted(table, value, "right")
        few, many = (hi > lo) & (hi - lo <= DENSE), hi - lo > DENSE
        pairs.verify(probes[few], home, lo[few], hi[few])
        if many.any():
            pairs.dense(probes[many], home, table, lo[many], hi[many])
    return links.label


def link_edges(nodes: DataFrame, n: int, radius: int = RADIUS, m: int | None = None, part_rows: int = PART_ROWS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints of ``nodes`` (column fp, distinct) whose components are those of all links."""
    m = m or tables_for(n, radius)
    most = radius // m
    sent = []
    for j, (shift, width) in enumerate(segments(m)):
        p = prefix_bits(n, width, part_rows)
        high = masks(width - p, width, most)
        seg = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1))
        sent.append(
            nodes.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in high])).alias("mask"))
            .select("fp", "mask", (F.lit(j << 40) + F.shiftrightunsigned(seg.bitwiseXOR(F.col("mask")), width - p)).cast("long").alias("part"))
        )
    rows = sent[0]
    for more in sent[1:]:
        rows = rows.unionByName(more)
    # parts beyond the limit are fewer than HEAVY_PARTS, because all rows together are limit * HEAVY_PARTS at most
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    total = n * sum(len(masks(w - prefix_bits(n, w, part_rows), w, most)) for _, w in segments(m))
    limit = max(heavy_rows, -(-total // HEAVY_PARTS))
    heavy = written(sizes.where(F.col("size") > limit).select("part", F.ceil(F.col("size") / limit).cast("int").alias("shares")), "heavy-parts")
    if heavy.limit(1).count():
        own = F.pmod(F.xxhash64("fp", "mask"), F.coalesce("shares", F.lit(1))).cast("int")
        to = F.when(F.col("mask") == 0, F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).otherwise(F.array(own))
        rows = rows.join(F.broadcast(heavy), "part", "left").select("fp", "mask", "part", own.alias("own"), F.explode(to).alias("share"))
        rows = rows.select("fp", "mask", "part", "share", (F.col("own") == F.col("share")).alias("probe"))
    else:
        rows = rows.select("fp", "mask", "part", F.lit(0).alias("share"), F.lit(True).alias("probe"))

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shift, width = segments(m)[int(key[0]) >> 40]
        fp = pdf["fp"].to_numpy().view(np.uint64)
        label = _part_links(fp, pdf["mask"].to_numpy().view(np.uint64), pdf["probe"].to_numpy(), shift, width, prefix_bits(n, width, part_rows), radius, most)
        moved = np.flatnonzero(label != np.arange(len(label)))
        out = pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})
        return out[out["a"] != out["b"]]

    return rows.groupBy("part", "share").applyInPandas(tidy(find), "a bigint, b bigint")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Large-star and small-star in turn; each round's edges are written to the shared
    folder, and the rounds end when an edge set comes back unchanged.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        led = both.join(least, "a")
        if large:
            out = led.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            out = led.select(F.col("b").alias("a"), F.col("root").alias("b")).union(least.select("a", F.col("root").alias("b")))
        return out.where("a != b").distinct()

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    held = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before, now = None, mark(held)
    for _ in range(rounds):
        if before == now:
            break
        last, held = held, written(star(star(held, True), False), "edges")
        drop(last)
        before, now = now, mark(held)
    if before != now:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, m: int | None = None) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id reachable by links."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(link_edges(nodes.select("fp"), nodes.count(), radius, m))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(of, prints["fp"] == of["_fp"]).select(id_col, "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    """``op9_simhash_dedup`` over all of ``documents``."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest id stays.

    A document without an id stays, since no other row can stand for it.  Of rows
    that repeat the smallest id, one stays: the one whose text comes first.
    """
    id_, nth, head = column("doc_id"), free(docs, "_nth"), free(docs, "_head")
    heads = groups(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(head)).distinct()
    kept = docs.join(heads, id_ == F.col(head), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_).orderBy(column("text")))
    return kept.select(*quoted(docs), first.alias(nth)).where(F.col(nth) == 1).drop(nth).unionByName(docs.where(id_.isNull()))
