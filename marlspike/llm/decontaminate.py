"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised the same way: A-Z in lower case, words are runs of
ASCII letters, digits and non-ASCII characters.  The rule maps every byte to one
byte, so a word's place in the normalised text is its place in the original.

A window is ``window`` consecutive words of an item; an item with fewer words, but
not none, is one window.  Words inside any occurrence of a window are hit.

The automaton runs over words as numbers (a few characters of a small alphabet each).
The items are cut into pieces of ``(window + 1) // 2`` words, so every window holds one
whole piece, and the first ``LEAD`` words of the pieces are its patterns.  Each text is
read once; around every pattern that is met, the windows that hold its piece are looked
up in the sorted table of all windows and compared word for word.

Defined results: null and empty texts have no words and are never contaminated;
items without words match nothing; items without an id hit words but add no id;
repeated rows are judged each on its own; an empty item table leaves every text clean;
extra columns are ignored, whatever their names.

Scale: texts never move.  Items of at most ``item_bytes`` bytes together (measured
first) are broadcast as they are, and each worker builds the automaton (about 55 bytes
of memory for a byte of item text, measured).  Beyond that nothing is broadcast: texts and items
are read into windows, and equal windows meet in a join by their 128-bit names, in
which a window stands once on the items' side however many items have it.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, filtered, free, output, tidy, written

WINDOW = 13
LEAD = 4
ITEM_BYTES = 8 << 20
_BASE = 64

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_KEEP).split()


def _name(data: bytes, seed: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data, seed)


class Items:
    """All windows of a list of (id, text), and the automaton over the pieces of the texts."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.window, self.piece = window, (window + 1) // 2
        self.ids = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.lines = [b" ".join(t) for t in texts]
        number: dict[bytes, int] = {}
        for found in texts:
            for w in found:
                number.setdefault(w, len(number))
        # a word is ``size`` digits; each place has an alphabet of its own, so no match begins inside a word
        self.size = next(n for n in range(1, 12) if _BASE**n >= len(number))
        self.code = {w: "".join(chr(256 + _BASE * j + k // _BASE**j % _BASE) for j in range(self.size)) for w, k in number.items()}
        self.none = " " * self.size
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        places: list[tuple[int, int, int, int]] = []  # of each window: name, item, first byte, last byte
        seed = 0
        for k, found in enumerate(texts):
            if not found:
                continue
            ends = np.cumsum([len(w) + 1 for w in found]).tolist()
            n = min(window, len(found))
            for a in range(0, max(1, len(found) - self.piece + 1), self.piece):
                lead = found[a : a + min(LEAD, self.piece)]
                machine.add_word("".join(map(self.code.__getitem__, lead)), len(lead))
            line = self.lines[k]
            for a in range(len(found) - n + 1):
                lo, hi = ends[a - 1] if a else 0, ends[a + n - 1] - 1
                places.append((_name(line[lo:hi], seed), k, lo, hi))
        while not self._sorted(places):  # two windows with one name: all names anew
            seed += 1
            places = [(_name(self.lines[k][lo:hi], seed), k, lo, hi) for _, k, lo, hi in places]
        self.seed = seed
        self.short = sorted({len(t) for t in texts if 0 < len(t) < window})
        self.machine = None
        if places:
            machine.make_automaton()
            self.machine = machine

    def _sorted(self, places: list[tuple[int, int, int, int]]) -> bool:
        """Put the windows in order of their names; False if one name has two texts."""
        name = np.fromiter((p[0] for p in places), np.uint64, len(places))
        order = np.argsort(name, kind="stable")
        self.name = name[order]
        self.item = np.fromiter((p[1] for p in places), np.int32, len(places))[order]
        self.lo = np.fromiter((p[2] for p in places), np.int32, len(places))[order]
        self.hi = np.fromiter((p[3] for p in places), np.int32, len(places))[order]
        same = np.flatnonzero(self.name[1:] == self.name[:-1])
        return all(self._line(k) == self._line(k + 1) for k in same.tolist())

    def _line(self, k: int) -> bytes:
        return self.lines[self.item[k]][self.lo[k] : self.hi[k]]

    @functools.lru_cache(1 << 16)  # noqa: B019 - one object in each worker
    def owners(self, window: bytes) -> frozenset | None:
        """The ids of the items that have the window; None if none has."""
        name = np.uint64(_name(window, self.seed))
        a = int(np.searchsorted(self.name, name, "left"))
        if a == len(self.name) or self.name[a] != name or self._line(a) != window:
            return None
        b = int(np.searchsorted(self.name, name, "right"))
        return frozenset(self.ids[k] for k in np.unique(self.item[a:b]).tolist()) - {None}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit runs as word index pairs [a, b), and items met."""
        found = words(text)
        if self.machine is None or not found:
            return len(found), [], set()
        code, none = self.code.get, self.none
        runs: list[tuple[int, int]] = []
        ids: set[str] = set()
        tried: set[tuple[int, int]] = set()
        for at, size in self.machine.iter("".join([code(w, none) for w in found])):
            first = at // self.size + 1 - size
            # the windows that hold the whole piece, or short items, which start with it
            spots = [(a, a + self.window) for a in range(max(0, first + self.piece - self.window), first + 1)] + [(first, first + n) for n in self.short]
            for a, b in spots:
                if b <= len(found) and (a, b) not in tried:
                    tried.add((a, b))
                    if (met := self.owners(b" ".join(found[a:b]))) is not None:
                        ids |= met
                        runs.append((a, b))
        return len(found), merged(runs), ids


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as code point offsets [start, end) in the original text."""
    if not runs:
        return []
    raw = np.frombuffer(text, np.uint8)
    full = np.concatenate(([0], (np.frombuffer(text.translate(_KEEP), np.uint8) != 32).view(np.int8), [0]))
    step = np.diff(full)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]


def _given(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(column(id_col).cast("string").alias("item"), column(text_col).cast("string").alias("text")).where("text is not null")


class _Shared:
    """A broadcast list of items; each Python worker builds its automaton once."""

    _built: dict[bytes, Items] = {}

    def __init__(self, spark, items: list[tuple[str | None, bytes]], window: int):
        self.held, self.window = spark.sparkContext.broadcast(items), window
        self.id = hashlib.sha256(repr((window, items)).encode()).digest()

    def get(self) -> Items:
        if self.id not in self._built:
            self._built.clear()
            self._built[self.id] = Items(self.held.value, self.window)
        return self._built[self.id]


_FOUND = "n_words bigint, n_hit bigint, items array<string>, starts array<bigint>, ends array<bigint>, contaminated boolean"


def _verdict(n: int, runs: list[tuple[int, int]]) -> tuple[int, bool]:
    hit = sum(b - a for a, b in runs)
    return hit, hit > 0 and 20 * hit >= n


def _rows(key: pa.Array, id_col: str, texts: list[bytes], seen: list[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    hits = [_verdict(n, runs) for n, runs, _ in seen]
    places = [spans(t, runs) for t, (_, runs, _) in zip(texts, seen)]
    return pa.RecordBatch.from_arrays(
        [key, pa.array([n for n, _, _ in seen], pa.int64()), pa.array([h for h, _ in hits], pa.int64()), pa.array([sorted(ids) for _, _, ids in seen], pa.list_(pa.string())), pa.array([[a for a, _ in x] for x in places], pa.list_(pa.int64())), pa.array([[b for _, b in x] for x in places], pa.list_(pa.int64())), pa.array([bad for _, bad in hits])],
        names=[id_col, "n_words", "n_hit", "items", "starts", "ends", "contaminated"],
    )


def _small(items: DataFrame, item_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= item_bytes


def _fetched(items: DataFrame, window: int) -> _Shared:
    held = [(r["item"], r["text"].encode()) for r in items.orderBy("item", "text").collect()]  # at most item_bytes, measured before
    return _Shared(items.sparkSession, held, window)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, hit runs in words, spans in code points, item ids met."""
    given = _given(items, item_col, item_text_col)
    texts = docs.select(column(id_col), column(text_col).cast("string").alias("_text"))
    out = output(docs, {id_col: id_col}, _FOUND)
    if not _small(given, item_bytes):
        return _joined(texts, given, id_col, window, out)
    shared = _fetched(given, window)

    def read(batches):
        for batch in batches:
            found = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            known = shared.get()
            yield _rows(batch.column(0), id_col, found, [known.scan(t) for t in found])

    return texts.mapInArrow(tidy(read), out)


def _windows(found: list[bytes], sizes: list[int]):
    """(start, words, two names) of all runs of the given numbers of words."""
    from xxhash import xxh3_128_digest

    for n in sizes:
        for a in range(len(found) - n + 1):
            digest = xxh3_128_digest(b" ".join(found[a : a + n]))
            yield a, n, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _joined(texts: DataFrame, items: DataFrame, id_col: str, window: int, out) -> DataFrame:
    """``contamination`` for items of any size: equal windows of texts and items meet in a join."""
    size = F.size(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != ""))
    sizes = [r[0] for r in items.select(F.least(size, F.lit(window)).alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # at most ``window`` numbers

    def cut(batches, mine):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = words(text or b"")
                rows = list(_windows(found, mine(len(found))))
                for k in range(0, len(rows), 100_000):
                    a, n, x, y = zip(*rows[k : k + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(a), batch.column(0).type), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["key", "a", "n", "x", "y"])

    def of_items(batches):
        return cut(batches, lambda n: [min(n, window)] if n else [])

    def of_texts(batches):
        return cut(batches, lambda n: [s for s in sizes if s <= n])

    rest = "a int, n int, x bigint, y bigint"
    held = written(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    owned = written(items.select("item", "text").mapInArrow(of_items, f"key string, {rest}").select(F.col("key").alias("item"), "n", "x", "y").distinct(), "item-windows")
    met = held.select("_row", "_text").mapInArrow(tidy(of_texts), f"key bigint, {rest}").join(owned.select("n", "x", "y").distinct(), ["n", "x", "y"])
    met = written(met.withColumnRenamed("key", "_row"), "met-windows")
    runs = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("a", (F.col("a") + F.col("n")).alias("b")))).alias("runs"))
    ids = met.select("_row", "n", "x", "y").distinct().join(owned.where("item is not null"), ["n", "x", "y"]).groupBy("_row").agg(F.collect_set("item").alias("ids"))
    both = held.join(runs, "_row", "left").join(ids, "_row", "left").select(column(id_col), "_text", "runs", "ids")

    def judge(batches):
        for batch in batches:
            found = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            seen = [(len(words(t)), merged([(r["a"], r["b"]) for r in runs or []]), set(ids or [])) for t, runs, ids in zip(found, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield _rows(batch.column(0), id_col, found, seen)

    return both.mapInArrow(tidy(judge), out)


def op8(spark, sf_dir: str) -> DataFrame:
    """``op8_decontaminate`` over all of ``documents`` and ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents judged contaminated go.

    Null and empty texts stay; repeated rows are judged each on its own; columns of any
    name come back as they are.
    """
    given = _given(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    if not _small(given, ITEM_BYTES):
        row = free(docs, "_row_no")
        held = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        bad = contamination(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).where("contaminated").select(row)
        return held.join(bad, row, "left_anti").drop(row)
    shared = _fetched(given, WINDOW)

    def clean(texts: list[bytes]) -> list[bool]:
        known = shared.get()
        return [not _verdict(*known.scan(t)[:2])[1] for t in texts]

    return filtered(docs, clean)


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as ws
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as ws
  from benchmark),
p as (
  select distinct item_id, least(13, len(ws)) as k, array_to_string(ws[s : s + least(13, len(ws)) - 1], ' ') as pat
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as s from i where len(ws) > 0)),
ks as (select distinct k from p),
g as (
  select doc_id, k, s, array_to_string(ws[s : s + k - 1], ' ') as pat
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as s from w, ks where len(ws) >= k)),
m as (select g.doc_id, g.s, g.k, p.item_id from g join p on g.k = p.k and g.pat = p.pat),
h as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(s, s + k)) as x from m) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from m group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join h using (doc_id) left join t using (doc_id)
"""
