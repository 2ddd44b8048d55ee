"""Document fingerprints: a digest of improbable features in chained Bloom filters.

* A feature is a window of ``WINDOW`` bytes of the UTF-8 text.  Its Shannon entropy is
  put into one of 1024 bins, and a bin is the rarer the fewer windows of the whole
  corpus fall into it (``rarity`` counts them; a table of ranks can be kept and
  given again).  Windows of very low entropy rank last.
* In every ``span`` consecutive windows the rarest (leftmost on ties) is marked; a
  window marked at least ``span / 4`` times is selected.  ``span`` is 64, less in
  texts with few windows, so short texts have features too.  A text of fewer than
  ``SHORT_TEXT`` bytes also has every window of 8 bytes as a feature.  Texts shorter
  than a window are padded with zero bytes.
* The distinct selected features, in order, go into Bloom filters of 2048 bits, five
  bits each, 160 features a filter; then the next filter of the chain begins.
* Likeness: for each filter of the shorter chain the best match in the other chain,
  (common - expected by chance) / (least possible - expected by chance), weighted by
  features.  Equal digests give 1.

Defined results: null texts are empty; an empty text has the digest without filters,
like another empty text (1) and unlike all others (0); a row without an id is
followed by itself; ids are of any type that has an order, rows that share one are
ordered by a hash of their text; extra columns are ignored.

Scale: texts are dealt once, by ranges of ids, and the first row of each range also
goes to the range before, so each row meets its successor without a global window.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import Ranges, least_runs, mix64, output, ranges_for, text_bytes

WINDOW = 32
SPAN = 64
SHORT_WINDOW = 8
SHORT_TEXT = 96
BITS = 2048
PER_FEATURE = 5
PER_FILTER = 160
BINS = 1024
LOW_ENTROPY = 0.3
BATCH_BYTES = 4 << 20
LEAST_BATCHES = 64
GROUP_BYTES = 2 << 20

_UNIT = 4096
_F = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))])
#: What one more occurrence of a byte, after c - 1 others, adds to the sum of c log2 c.
_GAIN = np.concatenate(([0], np.round(np.diff(_F) * _UNIT))).astype(np.int32)
_MOST = int(_GAIN.sum())
_TILE = 1 << 16


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin (0: one byte value only) of every window in ``data``."""
    n = len(data) - WINDOW + 1
    out = np.empty(n, np.uint16)
    for t in range(0, n, _TILE):
        x = data[t : min(t + _TILE, n) + WINDOW - 1]
        ahead, behind = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
        for j in range(1, WINDOW):
            same = (x[j:] == x[:-j]).view(np.uint8)
            ahead[: len(x) - j] += same
            behind[j:] += same
        first = int(_GAIN[behind[:WINDOW]].sum())  # occurrences so far within the first window
        move = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: len(x) - WINDOW]]
        total = np.concatenate(([first], first + np.cumsum(move, dtype=np.int64)))
        out[t : t + len(total)] = ((_MOST - total) * (BINS - 1) // _MOST).clip(0, BINS - 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy bin, rarest first; bins of very low entropy come last."""
    weak = np.arange(BINS) < LOW_ENTROPY * BINS
    order = np.lexsort((np.arange(BINS), counts, weak))
    out = np.empty(BINS, np.uint32)
    out[order] = np.arange(BINS, dtype=np.uint32)
    return out


class Digests:
    """Digests of a list of texts."""

    def __init__(self, texts: list[bytes], rank: np.ndarray):
        windows = np.fromiter((max(1, len(t) - WINDOW + 1) if t else 0 for t in texts), np.int64, len(texts))
        level = np.zeros(len(texts), np.int64)
        some = windows > 0
        level[some] = np.clip(np.floor(np.log2(np.maximum(windows[some] // 8, 1))).astype(np.int64), 0, SPAN.bit_length() - 1)
        owners, features = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in np.unique(level[some]):
            mine = np.flatnonzero(some & (level == k))
            size = np.cumsum([len(texts[i]) for i in mine])
            for group in np.split(mine, np.searchsorted(size, np.arange(GROUP_BYTES, size[-1], GROUP_BYTES))):
                if len(group):
                    o, f = self._features([texts[i] for i in group], 1 << int(k), rank)
                    owners.append(group[o])
                    features.append(f)
        if len(short := np.array([i for i, t in enumerate(texts) if 0 < len(t) < SHORT_TEXT], np.int64)):
            o, f = self._short_features([texts[i] for i in short])
            owners.append(short[o])
            features.append(f)
        owner, feature = np.concatenate(owners), np.concatenate(features)
        order = np.argsort(owner, kind="stable")
        owner, feature = owner[order], feature[order]
        first = self._distinct(owner, feature)
        owner, feature = owner[first], feature[first]
        self.count = np.bincount(owner, minlength=len(texts))
        chain = -(-self.count // PER_FILTER)
        self.at = np.concatenate(([0], np.cumsum(chain)))
        begin = np.concatenate(([0], np.cumsum(self.count)))
        nth = np.arange(len(owner)) - begin[owner]
        which = self.at[owner] + nth // PER_FILTER
        bits = np.zeros(int(self.at[-1]) * BITS, bool)
        for k in range(PER_FEATURE):
            bits[which * BITS + ((feature >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.filters = np.packbits(bits).reshape(-1, BITS // 8).view(np.uint64)
        self.weight = np.bincount(which, minlength=int(self.at[-1]))
        self.set = np.bitwise_count(self.filters).sum(axis=1, dtype=np.int64)

    @staticmethod
    def _distinct(owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Places of the first of each feature of each text, in order."""
        order = np.lexsort((feature, owner))  # stable
        new = np.ones(len(order), bool)
        new[1:] = (owner[order][1:] != owner[order][:-1]) | (feature[order][1:] != feature[order][:-1])
        return np.sort(order[new])

    @staticmethod
    def _features(texts: list[bytes], span: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each selected feature, in order."""
        texts = [t if len(t) >= WINDOW else t + bytes(WINDOW - len(t)) for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        values = rank[entropy_bins(data)] << np.uint32(17)
        place, lo, hi = least_runs(lambda a, b: values[a:b], starts, np.maximum(sizes - WINDOW + 1 - span + 1, 0), span)
        place = place[hi - lo + 1 >= span / 4]
        words = np.ndarray(shape=(len(joined) + 1,), dtype="<u8", buffer=joined + bytes(8), strides=(1,))
        h = np.zeros(len(place), np.uint64)
        for k in range(0, WINDOW, 8):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[place + k])
        return np.searchsorted(starts, place, "right") - 1, h

    @staticmethod
    def _short_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of every window of 8 bytes."""
        texts = [t.ljust(SHORT_WINDOW, b"\0") for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = sizes - SHORT_WINDOW + 1
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        joined = b"".join(texts)
        words = np.ndarray(shape=(len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
        return owner, mix64(words[at] + np.uint64(SHORT_WINDOW))

    def text(self, i: int) -> str:
        """The digest as a string: version, features, filters."""
        return f"id1:{self.count[i]}:" + base64.b64encode(self.filters[self.at[i] : self.at[i + 1]].tobytes()).decode()

    def likeness(self, i: int, other: Digests, j: int) -> float:
        """0 to 1: how far the bits of two digests overlap beyond chance."""
        a, b = slice(self.at[i], self.at[i + 1]), slice(other.at[j], other.at[j + 1])
        if self.count[i] == other.count[j] and np.array_equal(self.filters[a], other.filters[b]):
            return 1.0
        x, y = (self, a), (other, b)
        if x[1].stop - x[1].start > y[1].stop - y[1].start or (x[1].stop - x[1].start == y[1].stop - y[1].start and self.count[i] > other.count[j]):
            x, y = y, x
        if x[1].stop == x[1].start:
            return 0.0
        total = weight = 0.0
        theirs, their_set = y[0].filters[y[1]], y[0].set[y[1]]
        for f, n, w in zip(x[0].filters[x[1]], x[0].set[x[1]].tolist(), x[0].weight[x[1]].tolist()):
            common = np.bitwise_count(theirs & f).sum(axis=1, dtype=np.int64)
            chance = their_set * (n / BITS)
            best = float(((common - chance) / np.maximum(np.minimum(their_set, n) - chance, 1e-9)).max())
            total += w * min(1.0, max(0.0, best))
            weight += w
        return total / weight


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropy bins by how many windows of all texts fall into each."""

    def count(batches):
        found = np.zeros(BINS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text and len(text) >= WINDOW:
                    found += np.bincount(entropy_bins(np.frombuffer(text, np.uint8)), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(found)], names=["bin", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return ranks(counts)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each row: id, n_chars, digests of the text and its edited text, and their likeness."""
    rank = rarity(docs, text_col) if rank is None else rank
    size = text_bytes(docs, text_col)
    batches = ranges_for(size, batch_bytes, LEAST_BATCHES)
    id_ = F.col(id_col)
    ranges = Ranges(docs.where(id_.isNotNull()), id_col, text_col, batches, size)
    before = F.when(F.col("_home") == 1, F.lit(ranges.count)).otherwise(F.col("_home") - 1)
    lone = -1 - F.pmod(F.xxhash64("_text"), F.lit(batches)).cast("int")
    placed = docs.select(id_, F.col(text_col).cast("string").alias("_text"), ranges.key.alias("_key"), ranges.number().alias("_home"))
    begins = ranges.begins(F.col("_home"), F.col("_key"))
    to = F.when(F.col(id_col).isNull(), F.array(F.struct(lone.alias("batch"), F.lit(False).alias("guest")))).when(
        begins, F.array(F.struct(F.col("_home").alias("batch"), F.lit(False).alias("guest")), F.struct(before.alias("batch"), F.lit(True).alias("guest")))
    ).otherwise(F.array(F.struct(F.col("_home").alias("batch"), F.lit(False).alias("guest"))))
    dealt = placed.select(id_col, "_text", F.col("_key.b").alias("_mark"), F.explode(to).alias("_to")).select(id_col, "_text", "_mark", "_to.batch", "_to.guest")
    out = output(docs, {id_col: id_col}, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def digest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("guest").to_pylist(), table.column(id_col).to_pylist(), table.column("_mark").to_pylist(), (t or "" for t in table.column("_text").to_pylist())))
        own = sorted(r for r in rows if not r[0]) if key[0].as_py() > 0 else [r for r in rows if not r[0]]
        guest = min((r for r in rows if r[0]), default=None)
        texts = [r[3] for r in own]
        if not texts:
            return out_schema.empty_table()
        follow = texts if key[0].as_py() <= 0 else [*texts[1:], guest[3] if guest else texts[0]]
        changed = [edited(a, b) for a, b in zip(texts, follow)]
        raw = [t.encode() for t in changed]
        whole = Digests([t.encode() for t in [*texts, follow[-1]]], rank)
        other = Digests(raw, rank)
        n = len(texts)
        after = list(range(n)) if key[0].as_py() <= 0 else list(range(1, n + 1))
        return pa.table(
            {id_col: [r[1] for r in own], "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw], "fingerprint": [whole.text(i) for i in range(n)], "edited_fingerprint": [other.text(i) for i in range(n)], "near_edited": [whole.likeness(i, other, i) for i in range(n)], "near_next": [whole.likeness(i, whole, j) for i, j in enumerate(after)]},
            schema=out_schema,
        )

    out_schema = to_arrow_schema(out)
    return dealt.groupBy("batch").applyInArrow(digest, out)


def op1(spark, sf_dir: str) -> DataFrame:
    """``op1_digest`` over all of ``documents``."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
