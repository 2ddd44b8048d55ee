"""Byte-pair encoding and decoding in batched numpy merge rounds.

The vocabulary file (JSON of the tokenizers library) names the normaliser, how text is
split into words, the merges in order of rank, and an ending for a word's last symbol.
The symbols of many distinct words lie in one flat array with the number of their word.  A
round looks all neighbouring pairs up by binary search over the sorted keys of the merges,
takes each word's lowest rank, and merges all its pairs of that rank, left to right;
words without a pair left leave the array.  A symbol's own merge always has a lower rank
than merges of that symbol (checked when a file is read), so all pairs of one rank may go in one round.
Words of more than ``LONG`` symbols, which would need many rounds, have their pairs sorted
by rank instead: each rank that occurs is one round for all of them, and only neighbours of
merged symbols are looked up again.

Decoding looks token texts up by id and joins them as the file's decoder does: without one
by single spaces, with the byte-level one as bytes.

Defined results: null and empty texts have no tokens and decode to an empty text; tokens
added to the vocabulary (end of text, ...) are recognised inside texts, as the library
does; repeated rows, null ids and extra columns are kept apart or ignored; a text may be
of any length, of which one is in memory at a time beside its batch.

Scale: one scan, no shuffle.  White space ends a word, so texts are cut into chunks at it,
a chunk's tokens are found once for each ``CACHED`` distinct chunks of a task, and texts
are composed from them.  The vocabulary travels to tasks as one broadcast of the file's bytes (``MAX_FILE`` at most).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, column, output

LONG = 256
CACHED = 600_000
CACHED_CHARS = 64
ROUND_CHARS = 8 << 20
MAX_FILE = 64 << 20
VOCABULARY = "word_bpe_49k.json"
#: White space of the Unicode standard, which every splitter of these files leaves out or begins a word with.
SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the standard
_NONE = np.int32(2**31 - 1)


def file_bytes(path: str) -> bytes:
    """A vocabulary file; it is broadcast, so it may not be larger than ``MAX_FILE``."""
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    with open(path, "rb") as f:
        return f.read()


def byte_alphabet() -> list[str]:
    """The characters that stand for bytes 0 to 255: printable ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge rules (left id, right id, made id) by rank, and the rounds that apply them."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        last = {c: rank for rank, c in enumerate(made.tolist())}
        if len(last) < len(made) or any(last.get(x, -1) >= rank for rank, pair in enumerate(zip(left.tolist(), right.tolist())) for x in pair):
            raise ValueError("a symbol is made twice, or merged before it is made")
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.rank = np.append(order.astype(np.int32), _NONE)
        self.made = made.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` where no merge has it."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def apply(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words laid end to end, fully merged; and how many each word has left."""
        word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        long = (counts > LONG)[word]
        parts = [self._rounds(symbols[~long], word[~long]), self._by_rank(symbols[long], word[long])]
        symbols, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(counts))

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done = []
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins here
        if len(sym):
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(sym[:-1], sym[1:]), _NONE)
        while len(sym):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            live = np.repeat(least != _NONE, size)
            if not live.all():
                done.append((sym[~live], word[~live]))
                least = np.repeat(least, size)[live]
                sym, word, rank = sym[live], word[live], rank[live]
            else:
                least = np.repeat(least, size)
            if not len(sym):
                break
            at = _apart(np.flatnonzero(rank == least))
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            near = np.flatnonzero(touched)
            after = np.minimum(near + 1, len(sym) - 1)
            rank[near] = np.where((word[near] == word[after]) & (after > near), self.ranks(sym[near], sym[after]), _NONE)
        return (np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])) if done else (sym, word)

    def _by_rank(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sym)
        if not n:
            return sym, word
        sym = np.append(sym, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank = np.full(n + 1, _NONE, np.int32)
        held: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            to = after[at]
            near = (to < n) & (word[at] == word[np.minimum(to, n - 1)])
            found = np.where(near, self.ranks(sym[at], sym[to]), _NONE)
            rank[at] = found
            at, found = at[found != _NONE], found[found != _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                r = int(found[a])
                if r not in held:
                    held[r] = []
                    heapq.heappush(heap, r)
                held[r].append(at[a:b])

        look(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(held.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]  # two pairs that share a symbol
            at = at[_alternate(chained)]
            gone = after[at]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = _NONE
            after[at] = after[gone]
            inner = after[at] <= n
            before[after[at][inner]] = at[inner]
            left = before[at]
            look(np.unique(np.concatenate((at, left[left >= 0]))))
        kept = np.flatnonzero(alive[:n])
        return sym[kept], word[kept]


def _alternate(chained: np.ndarray) -> np.ndarray:
    """Of items that follow each other in chains, the first, third, ... of each chain."""
    place = np.arange(len(chained))
    start = np.maximum.accumulate(np.where(chained, 0, place))
    return (place - start) % 2 == 0


def _apart(at: np.ndarray) -> np.ndarray:
    """Pair starts without those that overlap a taken one to their left."""
    chained = np.zeros(len(at), bool)
    chained[1:] = at[1:] == at[:-1] + 1
    return at[_alternate(chained)] if chained.any() else at


class Vocabulary:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        held = json.loads(data)
        model = held["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("a plain BPE model is needed")
        if any(t[x] for t in held["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.ending = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.text: dict[int, str] = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(*(np.array([ids[x] for x in part], np.int64) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])))
        alphabet = byte_alphabet()
        if any(c + e not in ids for c in alphabet for e in ("", self.ending)):
            raise ValueError("the vocabulary lacks single bytes")
        self.inner = np.array([ids[c] for c in alphabet], np.int32)
        self.final = np.array([ids[c + self.ending] for c in alphabet], np.int32)
        self.byte_of = {ord(c): b for b, c in enumerate(alphabet)}
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.added_at = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.signed = not any(n.isalnum() for n in names)  # each has a character that is neither letter nor digit
        self.joins_bytes = (held["decoder"] or {}).get("type") == "ByteLevel"
        if held["decoder"] and not self.joins_bytes:
            raise ValueError("only the byte-level decoder, or none, is supported")
        # the library's own parts: which characters are letters follows its version of Unicode
        self.library = Tokenizer.from_str(data.decode())
        self.chunked, self.plain = _plain_rule(held)

    def words(self, chunk: str) -> list[bytes | int]:
        """The words (bytes) of a text, and ids of added tokens, in order."""
        if not self.added_at or (self.signed and chunk.isalnum()) or not self.added_at.search(chunk):
            return self._split(chunk)
        found: list[bytes | int] = []
        for part in self.added_at.split(chunk):
            found += [self.added[part]] if part in self.added else self._split(part)
        return found

    def _split(self, part: str) -> list[bytes | int]:
        if self.plain and (part.isascii() or max(part, default="") < SETTLED):
            return [w.encode() for w in self.plain(part)]
        normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
        return [bytes(map(self.byte_of.__getitem__, map(ord, w))) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        if not words:
            return []
        counts = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(counts) - 1
        symbols[ends] = self.final[data[ends]]
        flat, left = self.merges.apply(symbols, counts)
        flat, cuts = flat.tolist(), [0, *np.cumsum(left).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each text; equal words of all texts are merged once."""
        split = [self.words(c) for c in chunks]
        known: dict = dict.fromkeys(w for s in split for w in s if type(w) is bytes)
        known = dict(zip(known, self.encode_words(list(known))))
        return [list(chain.from_iterable([w] if type(w) is int else known[w] for w in s)) for s in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text as a whole."""
        cut = [self.cut(t) for t in texts]
        found = iter(self.encode_chunks([c for t in cut for c in t]))
        return [list(chain.from_iterable(next(found) for _ in t)) for t in cut]

    def cut(self, text: str) -> list[str]:
        """Chunks that may be encoded apart."""
        if not self.chunked:
            return [text] if text else []
        return _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        tokens = map(self.text.__getitem__, ids)
        if not self.joins_bytes:
            return " ".join(tokens)
        found = b"".join(as_bytes(t) if any(ord(c) not in self.byte_of for c in t) else bytes(self.byte_of[ord(c)] for c in t) for t in tokens)
        return found.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def loaded(data: bytes) -> Vocabulary:
    """The vocabulary, kept for the next task of a worker."""
    return Vocabulary(data)


#: Fixed value: the split of the lower-casing word vocabulary, as its file has it, without white space.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Below this character all versions of Unicode agree on letters, numbers, case and composition.
SETTLED = "\u0530"


def _plain_rule(held: dict):
    """Whether texts fall apart at white space, and how a chunk of settled characters is split into words (None: as the library does)."""
    normal = [n.get("type") for n in (held.get("normalizer") or {}).get("normalizers", [])]
    split = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern", {}).get("Regex") == _WORDS
    if not drops or normal != ["NFC", "Replace", "Lowercase"]:
        return False, None
    words = regex.compile(_WORDS)

    def plain(part: str) -> list[str]:
        # case goes letter by letter, so a last sigma is like any other
        part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        return [part] if part.isalpha() else words.findall(part)

    return True, plain


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Id, n_tokens, ids_sha256, decoded_sha256 for each document; ``with_ids`` adds ``ids`` and ``decoded``."""
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(path))
    packed = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    out = output(docs, {id_col: id_col}, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)

    def run(batches):
        vocabulary = loaded(data.value)
        name = [str(i) for i in range(max(vocabulary.text) + 1)]
        # without a decoder a text's decoding is its chunks', joined by the same space as their tokens
        apart = vocabulary.chunked and not vocabulary.joins_bytes
        known: dict[str, tuple[int, str, str]] = {}  # of a chunk

        def whole(ids: list[int]) -> tuple[int, str, str]:
            return len(ids), " ".join([name[i] for i in ids]), vocabulary.decode(ids)

        def composed(texts: list[str]) -> list[tuple[int, str, str]]:
            """Texts of a batch share the rounds of their new chunks."""
            cuts = [vocabulary.cut(t) for t in texts]
            fresh = list(set().union(*cuts).difference(known))
            if len(known) + len(fresh) > CACHED:
                known.clear()
                fresh = list(set().union(*cuts))
            known.update(zip(fresh, map(whole, vocabulary.encode_chunks(fresh))))
            rows = []
            for chunks in cuts:
                n, ids, decoded = zip(*map(known.__getitem__, chunks)) if chunks else ((), (), ())
                rows.append((sum(n), " ".join(ids), " ".join(decoded)))
            for c in fresh:
                if len(c) > CACHED_CHARS:
                    del known[c]
            return rows

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cuts, held = [0], 0
            for k, t in enumerate(texts):
                if held and held + len(t) > ROUND_CHARS:
                    cuts.append(k)
                    held = 0
                held += len(t)
            cuts.append(len(texts))
            for a, b in zip(cuts, cuts[1:]):
                part = texts[a:b]
                rows = composed(part) if apart else [whole(ids) for ids in vocabulary.encode(part)]
                columns = [batch.column(0).slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([hashlib.sha256(r[j].encode()).hexdigest() for r in rows], pa.string()) for j in (1, 2))]
                if with_ids:
                    columns += [pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return packed.mapInArrow(run, out)


def op13(spark, sf_dir: str) -> DataFrame:
    """``op13_bpe_codec`` over all of ``documents`` with the lower-casing word vocabulary."""
    from public_tokenizers import path

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path(VOCABULARY))
