"""Suffix-array dedup: bucket-pointer refinement over all byte offsets of a corpus.

A byte goes if it is covered by a ``length``-byte string that also starts earlier
(smaller id, or earlier in the same document).  Telling this needs, of the suffix
array, only which suffixes share their first ``length`` bytes and which of those
comes first, so buckets of suffixes are refined up to that depth and no further:

1. *Initial q-gram buckets.*  Every ``length``-byte string is represented by one of
   the q-grams in it (the least by a content hash, leftmost on ties), so equal
   strings are represented by equal q-grams at equal distances and only about one
   offset in thirty is bucketed.  Offsets that follow each other and share their
   representative form a run.  A q-gram bucket with one run is finished.
2. *Refinement by the identifiers of later offsets.*  A bucket's identifier is a content
   name, so executors agree on it without a global sort: those of depth 2d are refined
   from those of depth d, of an offset and of the offset d later, for all offsets of a
   tile at once and from exact 8-byte words up, so each depth reuses the one before.
   Within a q-gram bucket, runs are sorted by the identifiers of their first and last
   strings; all of a run's strings occur earlier if an equal run does, and a bucket that
   has only equal runs is finished.
3. *Full depth.*  Where runs of one bucket differ (edges of a shared passage, edits),
   each string of the first run of each kind is sorted by its own pointer at full
   depth (128 bits), and every one but the first in its final bucket occurs earlier.

Defined results: null and empty texts have no bytes; a text shorter than ``length``
loses nothing; ids are of any type that has an order, null ids come before all others;
rows that share an id are ordered by a hash of their text, equal rows by position, so of
equal rows one stays; extra columns are ignored.

Memory follows the batch, not the longest text: where a text is longer than a batch, texts go
in pieces of ``piece_bytes`` (with the ``length`` - 1 bytes that follow), whose removed runs
are joined again by document; only that last step holds a whole text.

Scale: texts are dealt once into batches by ranges of ids and text hashes
(``batch_bytes`` each, so an id that many rows share is many batches), and all later steps reuse that exchange.
The driver holds the bounds of ``max_ranges`` ranges at most; a larger corpus has ranges of
several batches, which a running sum within each range tells apart (one more exchange of the
text).  Between steps only sorted pointers travel, as
one block for each batch and part, and a flag comes back for each.  A batch sends each
pointer once and at most ``PER_GRAM`` runs for a q-gram (the others are refined to
full depth), so a passage in a third of all documents costs a part one entry for each
batch, not one for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import MAX_RANGES, Ranges, column, least_runs, mix64, output, ranges_for, tidy

LENGTH = 100
GRAM = 36
BATCH_BYTES = 4 << 20
LEAST_BATCHES = 64
PART_KEYS = 400_000
PER_GRAM = 4
TILE = 1 << 17
SLICE = 1 << 19
PIECE_BYTES = 1 << 20

CLEAN, EARLIER, MIXED = 0, 1, 2


class Batch:
    """The texts of one batch as one byte string, in the order of the corpus."""

    def __init__(self, table: pa.Table, id_col: str):
        ids = table.column(id_col).to_pylist()
        texts = table.column("_text").cast(pa.binary()).to_pylist()
        marks = table.column("_mark").to_pylist()
        ties = [(k or "", at) for k, at in zip(table.column("_key").to_pylist(), table.column("_at").to_pylist())] if "_key" in table.column_names else texts
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, marks[i], ties[i] or b""))
        self.missing = [texts[i] is None for i in self.order]
        self.texts = [texts[i] or b"" for i in self.order]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        joined = b"".join(self.texts)
        self.data = np.frombuffer(joined, np.uint8)
        padded = joined + bytes(8)
        self.words = np.ndarray(shape=(len(joined) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def pointer(self, at: np.ndarray, depth: int, lanes: int = 2) -> list[np.ndarray]:
        """Bucket identifiers of the strings of ``depth`` (8 or more) bytes at sorted ``at``, in independent lanes of 64 bits.

        Tile by tile, the identifiers of all offsets are refined from depth d to 2d by those
        of the offsets d later, from words of 8 bytes up, until one more step gives
        ``depth``; where few offsets are asked for, only theirs are.
        """
        out = [np.empty(len(at), np.uint64) for _ in range(lanes)]
        half = 1 << ((depth - 1).bit_length() - 1)
        begin = 0
        while begin < len(at):
            t = int(at[begin])
            end = int(np.searchsorted(at, t + TILE, "left"))
            if (end - begin) * (depth // 8) * 2 < int(at[end - 1]) - t:
                found = self._at(at[begin:end], depth, lanes)
            else:
                bucket = _words(self.words[t : int(at[end - 1]) + depth - 7], lanes)
                d = 8
                while d < half:
                    bucket = _refined([x[:-d] for x in bucket], [x[d:] for x in bucket])
                    d *= 2
                x = at[begin:end] - t
                found = [b[x] for b in bucket] if depth == 8 else _refined([b[x] for b in bucket], [b[x + depth - half] for b in bucket])
            for lane, values in zip(out, found):
                lane[begin:end] = values
            begin = end
        return out

    def _at(self, at: np.ndarray, depth: int, lanes: int) -> list[np.ndarray]:
        """The same identifiers for single offsets."""
        if depth == 8:
            return _words(self.words[at], lanes)
        half = 1 << ((depth - 1).bit_length() - 1)
        return _refined(self._at(at, half, lanes), self._at(at + (depth - half), half, lanes))

    def runs(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Representative, first and last string start of each run, in order."""
        return least_runs(lambda a, b: _gram_keys(self.data[a : b + gram - 1], gram), self.starts, np.maximum(self.sizes - length + 1, 0), length - gram + 1)


def _words(word: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Identifiers of words of 8 bytes, one to one in each lane."""
    found = [word * np.uint64(0x9E3779B97F4A7C15)]
    if lanes > 1:
        found.append((word ^ (word >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))
    return found


def _refined(near: list[np.ndarray], later: list[np.ndarray]) -> list[np.ndarray]:
    """Identifiers of the buckets into which those of an offset and of a later one refine each other."""
    return [mix64(x * np.uint64(k) + (y ^ (y >> np.uint64(32)))) for x, y, k in zip(near, later, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))]


def _gram_keys(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit content hash of each q-gram, doubled up from single bytes."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    d = 1
    while d < gram:
        more = min(d, gram - d)
        y = h[more:]
        h = h[: len(h) - more] * np.uint32(0x85EBCA77) + (y ^ (y >> np.uint32(15)))
        d += more
    return (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct key in order of the keys, and for each place the number of its key."""
    order = np.lexsort((*keys[::-1],))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Runs:
    """A batch's runs with their q-gram buckets and run pointers, and which of them are asked about."""

    def __init__(self, batch: Batch, length: int, gram: int):
        self.place, self.lo, self.hi = batch.runs(length, gram)
        (self.gram,) = batch.pointer(self.place, gram, 1)
        (first,), (last,) = batch.pointer(self.lo, length, 1), batch.pointer(self.hi, length, 1)
        shape = ((self.hi - self.lo) << 8 | (self.place - self.lo)).astype(np.uint64)
        self.pointer = mix64(mix64(first + shape) * np.uint64(0x9FB21C651E98DF25) + last)
        head, self.kind = _firsts(self.gram, self.pointer)
        self.head = head  # first run of each kind, sorted by q-gram
        grams = self.gram[head]
        nth = np.arange(len(head)) - np.searchsorted(grams, grams, "left")
        self.asked = np.flatnonzero(nth < PER_GRAM)  # kinds that are sent

    def verdict(self, flags: np.ndarray) -> np.ndarray:
        """CLEAN, EARLIER or MIXED for each run, from the flags of the kinds that were sent."""
        kinds = np.full(len(self.head), MIXED, np.uint8)
        kinds[self.asked] = flags
        out = kinds[self.kind]
        again = np.ones(len(out), bool)
        again[self.head] = False
        out[again] = EARLIER
        return out


class Strings:
    """Strings of the mixed runs at full depth; the first of each pointer is asked about, and all others occur earlier.

    Pointers are made for ``SLICE`` strings at a time, of which only those of first strings are kept.
    """

    def __init__(self, batch: Batch, runs: Runs, verdict: np.ndarray, length: int):
        mixed = np.flatnonzero(verdict == MIXED)
        lo, n = runs.lo[mixed].astype(np.int32), (runs.hi[mixed] - runs.lo[mixed] + 1).astype(np.int32)
        before = np.cumsum(n, dtype=np.int32) - n
        self.at = np.repeat(lo - before, n)
        self.at += np.arange(len(self.at), dtype=np.int32)
        heads, keys = [np.zeros(0, np.int32)], [[np.zeros(0, np.uint64)] * 2]
        for k in range(0, len(self.at), SLICE):
            found = batch.pointer(self.at[k : k + SLICE], length)
            first, _ = _firsts(*found)
            first.sort()
            heads.append((first + k).astype(np.int32))
            keys.append([x[first] for x in found])
        head, key = np.concatenate(heads), [np.concatenate(x) for x in zip(*keys)]
        first, _ = _firsts(*key)
        self.head = head[first]
        self.key = [k[first] for k in key]  # sorted

    def verdict(self, flags: np.ndarray) -> np.ndarray:
        out = np.ones(len(self.at), bool)
        out[self.head] = flags == EARLIER
        return out


def _blocks(batch_no: int, step: int, parts: int, *keys: np.ndarray) -> pa.Table:
    """Sorted keys, cut by ranges of the first key into one block for each part."""
    part = ((keys[0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))  # of the parts that have keys
    edges = [*first.tolist(), len(part)]
    data = [np.concatenate([k[a:b] for k in keys]).tobytes() for a, b in zip(edges, edges[1:])]
    n = len(first)
    return pa.table({"part": pa.array(part[first].astype(np.int32)), "batch": pa.array([batch_no] * n, pa.int64()), "step": pa.array([step] * n, pa.int32()), "data": pa.array(data, pa.binary())}, schema=_BLOCK)


_BLOCK = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("step", pa.int32()), ("data", pa.binary())])


def _judge(table: pa.Table, step: int) -> pa.Table:
    """One part's flags: for each key, whether an earlier batch has it, or (runs) its q-gram bucket is mixed."""
    rows = sorted(zip(table.column("batch").to_pylist(), table.column("data").to_pylist()))
    pairs = [np.frombuffer(data, np.uint64).reshape(2, -1) for _, data in rows]
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.lexsort((y, x))  # stable, so batches stay in order
    a, b = x[order], y[order]
    new_x, new = np.ones(len(a), bool), np.ones(len(a), bool)
    new_x[1:] = a[1:] != a[:-1]
    new[1:] = new_x[1:] | (b[1:] != b[:-1])
    flags = np.empty(len(a), np.uint8)
    if step == 1:
        head = np.flatnonzero(new_x)
        kinds = np.add.reduceat(new.astype(np.int64), head)
        mixed = np.repeat(kinds > 1, np.diff(np.append(head, len(a))))
        flags[order] = np.where(new, np.where(mixed, MIXED, CLEAN), EARLIER)
    else:
        flags[order] = np.where(new, CLEAN, EARLIER)
    ends = np.cumsum([p.shape[1] for p in pairs])
    return pa.table({"part": table.column("part").combine_chunks(), "batch": pa.array([r[0] for r in rows], pa.int64()), "step": pa.array([step] * len(rows), pa.int32()), "data": pa.array([flags[e - p.shape[1] : e].tobytes() for e, p in zip(ends, pairs)], pa.binary())}, schema=_BLOCK)


def _flags(answers: pa.Table, step: int) -> np.ndarray:
    """The flags of one step in the order in which its keys were sent."""
    rows = sorted((p, d) for p, s, d in zip(answers.column("part").to_pylist(), answers.column("step").to_pylist(), answers.column("data").to_pylist()) if s == step)
    return np.frombuffer(b"".join(d for _, d in rows), np.uint8)


def removed_runs(batch: Batch, runs: Runs, verdict: np.ndarray, strings: Strings, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs [a, b) of a batch; they never cross documents."""
    gone = verdict == EARLIER
    covered = np.zeros(len(batch.data) + 2, bool)  # shifted by one, so both ends are clear
    again = strings.at[repeated]
    if len(again):  # strings in order: neighbours overlap or touch until a gap
        cut = np.flatnonzero(np.diff(again) > length)
        for lo, hi in zip(again[np.append(0, cut + 1)].tolist(), again[np.append(cut, len(again) - 1)].tolist()):
            covered[lo + 1 : hi + length + 1] = True
    for lo, hi in zip(runs.lo[gone].tolist(), runs.hi[gone].tolist()):
        covered[lo + 1 : hi + length + 1] = True
    edge = covered[1:] != covered[:-1]
    edge[batch.starts] |= covered[1:][batch.starts] & covered[:-1][batch.starts]
    cut = np.flatnonzero(edge)
    inside = covered[1:][cut]
    a = cut[inside]
    b = np.array([], np.int64) if not len(cut) else np.append(cut[1:], len(batch.data))[inside]
    return a, b


def cut_ranges(dealt: DataFrame, id_col: str, batch_bytes: int) -> DataFrame:
    """Ranges (``_batch``) cut into batches of about ``batch_bytes`` of text, numbered in the order of the corpus."""
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    ties = ["_key", "_at"] if "_key" in dealt.columns else ["_text"]
    order = Window.partitionBy("_batch").orderBy(F.col(id_col).asc_nulls_first(), "_mark", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.floor((F.sum(size).over(order) - size) / F.lit(batch_bytes))
    return dealt.withColumn("_batch", F.shiftleft("_batch", 32) + nth)


def in_pieces(dealt: DataFrame, piece_bytes: int, length: int) -> DataFrame:
    """Texts cut into pieces (``_text``, of ``_size`` bytes in all) of ``piece_bytes`` string starts from byte ``_at`` on; other columns stay with the first piece.

    A piece also has the ``length`` - 1 bytes that its last strings reach into.  Equal
    texts of one id have their pieces side by side, so of each the first row's come first.
    """
    raw, rest = F.col("_text").cast("binary"), [c for c in dealt.columns if c == "_row"]
    cut = dealt.withColumn("_key", F.sha2(raw, 256)).withColumn("_size", F.octet_length("_text").cast("long")).withColumn("_at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.coalesce("_size", F.lit(0)) - 1), F.lit(piece_bytes).cast("long"))))
    once = {c: F.when(F.col("_at") == 0, F.col(c)).alias(c) for c in rest}
    kept = [once.get(c, F.substring(raw, F.col("_at") + 1, F.lit(piece_bytes + length - 1)).alias(c) if c == "_text" else column(c)) for c in dealt.columns]
    return cut.select(*kept, "_key", "_size", "_at")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, max_ranges: int = MAX_RANGES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256, byte spans.

    ``carry`` columns come back as struct ``row``; ``keep_text`` adds ``kept``: the text
    without the characters that lost all of their bytes (null for null).
    """
    size, longest = docs.agg(*[F.coalesce(f(F.octet_length(column(text_col).cast("string")).cast("long")), F.lit(0)) for f in (F.sum, F.max)]).first()
    batches = ranges_for(size, batch_bytes, LEAST_BATCHES, max_ranges)
    parts = max(LEAST_BATCHES, -(-size // (PART_KEYS * 25)))
    ranges = Ranges(docs, id_col, text_col, batches, size)
    row = [F.struct(*[column(c) for c in carry]).alias("_row")] if carry else []
    dealt = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *row, ranges.key["b"].alias("_mark"), ranges.number().cast("long").alias("_batch"))
    pieces = longest > max(batch_bytes, piece_bytes)
    if pieces:
        dealt = in_pieces(dealt, piece_bytes, length)
    if pieces or batches * batch_bytes < size:
        dealt = cut_ranges(dealt, id_col, batch_bytes)
    blocks = "part int, batch bigint, step int, data binary"
    piece_columns = [id_col, "_key", "_at", "_size", "_text", *(["_row"] if carry else []), "batch", "place", "starts", "ends"]

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        runs = Runs(Batch(table, id_col), length, gram)
        head = runs.head[runs.asked]
        return _blocks(key[0].as_py(), 1, parts, runs.gram[head], runs.pointer[head])

    def second(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, id_col)
        runs = Runs(batch, length, gram)
        strings = Strings(batch, runs, runs.verdict(_flags(answers, 1)), length)
        return _blocks(key[0].as_py(), 2, parts, *strings.key)

    def last(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, id_col)
        runs = Runs(batch, length, gram)
        verdict = runs.verdict(_flags(answers, 1))
        strings = Strings(batch, runs, verdict, length)
        a, b = removed_runs(batch, runs, verdict, strings, strings.verdict(_flags(answers, 2)), length)
        lo, hi = np.searchsorted(a, batch.starts[:-1]), np.searchsorted(a, batch.starts[1:])
        if pieces:
            begun = [table.column("_at")[i].as_py() for i in batch.order]
            spans = [((a[i:j] - start + at).tolist(), (b[i:j] - start + at).tolist()) for start, i, j, at in zip(batch.starts[:-1].tolist(), lo.tolist(), hi.tolist(), begun)]
            held = table.take(pa.array(batch.order, pa.int64()))
            parts_of = {"batch": pa.array([key[0].as_py()] * len(spans), pa.int64()), "place": pa.array(range(len(spans)), pa.int64()), "starts": pa.array([x for x, _ in spans], pa.list_(pa.int64())), "ends": pa.array([x for _, x in spans], pa.list_(pa.int64()))}
            return pa.table({name: parts_of[name] if name in parts_of else held.column(name) for name in piece_columns})
        found = [_left(text, missing, (a[i:j] - start).tolist(), (b[i:j] - start).tolist(), keep_text) for text, missing, start, i, j in zip(batch.texts, batch.missing, batch.starts[:-1].tolist(), lo.tolist(), hi.tolist())]
        return pa.table({id_col: table.column(id_col).take(pa.array(batch.order, pa.int64())), **_columns(found, keep_text), **({"row": table.column("_row").take(pa.array(batch.order, pa.int64()))} if carry else {})})

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A text from its pieces."""
        held = sorted(range(len(table)), key=lambda i: table.column("_at")[i].as_py())
        text = b"".join((table.column("_text")[i].as_py() or b"")[:piece_bytes] for i in held[:-1]) + (table.column("_text")[held[-1]].as_py() or b"")
        x, y = [], []
        for i in held:
            for p, q in zip(table.column("starts")[i].as_py(), table.column("ends")[i].as_py()):
                if y and p <= y[-1]:
                    y[-1] = max(q, y[-1])
                else:
                    x.append(p)
                    y.append(q)
        first = pa.array(held[:1], pa.int64())
        found = [_left(text, table.column("_size")[held[0]].as_py() is None, x, y, keep_text)]
        return pa.table({id_col: table.column(id_col).take(first), **_columns(found, keep_text), **({"row": table.column("_row").take(first)} if carry else {})})

    def judged(rows: DataFrame, step: int) -> DataFrame:
        def judge(table: pa.Table) -> pa.Table:
            return _judge(table, step)

        return rows.groupBy("part").applyInArrow(tidy(judge), blocks)

    one = judged(dealt.groupBy("_batch").applyInArrow(tidy(first), blocks), 1)
    two = judged(dealt.groupBy("_batch").cogroup(one.groupBy("batch")).applyInArrow(tidy(second), blocks), 2)
    out = output(docs, {id_col: id_col}, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>" + ", kept string" * keep_text)
    if carry:
        out = out.add("row", dealt.schema["_row"].dataType, True)
    joined = dealt.groupBy("_batch").cogroup(one.union(two).groupBy("batch"))
    if not pieces:
        return joined.applyInArrow(tidy(last), out)
    of_piece = output(dealt, {c: c for c in piece_columns if c in dealt.columns}, "batch bigint, place bigint, starts array<bigint>, ends array<bigint>")
    copy = F.row_number().over(Window.partitionBy(id_col, "_key", "_at").orderBy("batch", "place"))
    return joined.applyInArrow(tidy(last), of_piece).withColumn("_copy", copy).groupBy(id_col, "_key", "_copy").applyInArrow(tidy(whole), out)


def _left(text: bytes, missing: bool, x: list[int], y: list[int], keep_text: bool) -> tuple:
    """What is left of a text without its removed runs: digest, bytes, removed bytes, runs, and the text itself."""
    edges = [0, *(v for pair in zip(x, y) for v in pair), len(text)]
    left = b"".join(text[p:q] for p, q in zip(edges[::2], edges[1::2])) if x else text
    kept = None if missing or not keep_text else without_characters(text, x, y) if x else text.decode()
    return hashlib.sha256(left).hexdigest(), len(text), len(text) - len(left), x, y, kept


def _columns(found: list[tuple], keep_text: bool) -> dict[str, pa.Array]:
    digest, size, gone, begin, end, kept = zip(*found)
    spans = pa.list_(pa.int64())
    out = {"n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(map(len, begin), pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "starts": pa.array(begin, spans), "ends": pa.array(end, spans)}
    return out | ({"kept": pa.array(kept, pa.string())} if keep_text else {})


def without_characters(text: bytes, starts: list[int], ends: list[int]) -> str:
    """The text without the characters that lie wholly in removed runs."""
    edges = [0]
    for a, b in zip(starts, ends):
        while a < len(text) and text[a] & 0xC0 == 0x80:  # a character begun before stays
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:  # one that ends after stays
            b -= 1
        edges += [a, max(a, b)]
    edges.append(len(text))
    return b"".join(text[p:q] for p, q in zip(edges[::2], edges[1::2])).decode()


def op7(spark, sf_dir: str) -> DataFrame:
    """``op7_suffix_dedup`` over all of ``documents``."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: removed characters leave the texts; every document stays, and n_chars follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]  # the text travels once
    found = repeats(docs, carry=rest, keep_text=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, (strlen(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as m from (select doc_id, h, unnest(range(0, n - 99)) as p from d where n >= 100)),
r as (select doc_id, p from w qualify row_number() over (partition by m order by doc_id, p) > 1),
i as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from
  (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as fresh from r)),
s as (select doc_id, run, min(p) as a, max(p) + 100 as b from i group by doc_id, run),
g as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from s
  union all select doc_id, max(b), null from s group by doc_id),
k as (select g.doc_id, string_agg(case when y is null then substr(h, 2 * x + 1) else substr(h, 2 * x + 1, 2 * (y - x)) end, '' order by x) as kept from g join d using (doc_id) group by g.doc_id),
t as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from s group by doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join t using (doc_id) left join k using (doc_id)
"""
