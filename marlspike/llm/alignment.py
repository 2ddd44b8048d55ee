"""Cross-tokenizer alignment by segment deduplication.

Two tokenizers cut the same bytes (a space and the text) into tokens.  Offsets where both
end a token cut them into groups; each pair of an A and a B token whose byte ranges overlap
is a link; an id pair's count says how many links of the corpus hold it.

1. *Segments.*  Texts are cut before runs of white space where neither vocabulary can join
   across: A's splitter never puts white space behind another character, and ``safe_space``
   keeps only the white space that no piece of B (nor token of A) has behind another
   character.  So tokens, groups and links of a text are those of its segments, laid end to end.
2. *Distinct segments are tokenised and aligned once.*  Texts are dealt into batches; a batch
   sends each part of the segment space its distinct segments of that part, sorted, with their
   counts.  A part tokenises each of its segments once and aligns all of them in one
   sweep over sorted token ends.
3. *Pair counts.*  Parts add up links by id pair before they are shuffled; the best count
   of each B id follows, and each part asks for the pairs it has.
4. *Alignments join back.*  A part answers each batch in the order in which it asked, and
   batches compose their documents from segments.

Defined results: texts that are null, empty, or hold U+2581 (which the piece vocabulary
reads as a space, so its bytes would differ) have no tokens, zeros and an empty digest, and
count nowhere; the vocabularies are checked to keep all other bytes, and every
segment's bytes are compared; strings of special tokens are plain text; repeated rows are
documents of their own; null ids stay; extra columns are ignored.

Scale: a frequent segment is one entry for each batch and a frequent pair one row for each
part, however many documents hold them.  A batch has about ``BATCH_BYTES`` of text, or one text.
Vocabulary files travel as broadcasts of at most ``bpe.MAX_FILE`` each; pair counts are joined, not broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, byte_alphabet, file_bytes
from .shared import as_bytes, column, output, text_bytes, tidy, written

BATCH_BYTES = 24 << 20
PART_BYTES = 16 << 20
LEAST = 48
MARK = "▁"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
_SPACES = re.compile(f"[{SPACE}]")


class Pair:
    """Tokenizers A (JSON, byte-level) and B (sentencepiece), their tokens' bytes, and where texts may be cut."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        held = json.loads(a)
        split = held["pre_tokenizer"] or {}
        if held["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or held["model"]["type"] != "BPE":
            raise ValueError("A must be byte-level BPE without a normaliser")
        ids = held["model"]["vocab"]
        alphabet = byte_alphabet()
        if any(c not in ids for c in alphabet):
            raise ValueError("A lacks single bytes")
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token))

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(b)
        normal, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("B must keep texts as they are, put a space before them and fall back to bytes")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("pieces that are not merged are not supported")
        normal.add_dummy_prefix = False  # the space is part of the first segment
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(MARK, " ").encode() if p.type == kind.NORMAL else b"" for p in model.pieces]
        if len({x for x, p in zip(self.b_bytes, model.pieces) if p.type == kind.BYTE}) < 256:
            raise ValueError("B lacks single bytes")
        pieces = [p.piece.replace(MARK, " ") for p in model.pieces if p.type == kind.NORMAL]
        self.space = safe_space([*pieces, *(x.decode("utf-8", "replace") for x in self.a_bytes)])
        rest = "".join(c for c in _all_space() if c not in self.space)
        go_on = f"(?:[{re.escape(rest)}][{SPACE}]*[^{SPACE}]*)*" if rest else ""
        self.segment = re.compile(f"(?:[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+){go_on}")
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))

    def segments(self, text: str | None) -> list[str]:
        """The segments of a space and the text, in order; none for texts without tokens."""
        return self.segment.findall(" " + text) if text and MARK not in text else []

    def align(self, segments: list[str]) -> Aligned:
        """All segments tokenised and aligned."""
        return Aligned(self, segments)


@lru_cache(maxsize=1)
def loaded(a: bytes, b: bytes) -> Pair:
    """The pair, kept for the next group of a worker."""
    return Pair(a, b)


def _all_space() -> str:
    return "".join(c for c in map(chr, range(0x3001)) if _SPACES.match(c))


def safe_space(tokens: list[str]) -> str:
    """White space that no token has behind another character, so that nothing is joined across it."""
    unsafe = {y for t in tokens if len(t) > 1 for x, y in zip(t, t[1:]) if _SPACES.match(y) and not _SPACES.match(x)}
    return "".join(c for c in _all_space() if c not in unsafe)


class Aligned:
    """Tokens, groups and links of segments laid end to end.

    ``links`` are the stretches between neighbouring token ends of either side: each lies
    in one A and one B token, and each pair that overlaps has one.
    """

    def __init__(self, pair: Pair, segments: list[str]):
        data = [s.encode() for s in segments]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        a_ids = [e.ids for e in pair.a.encode_batch(segments, add_special_tokens=False)]
        b_ids = pair.b.encode(segments, num_threads=1) if segments else []
        sides = []
        for ids, names, sizes in ((a_ids, pair.a_bytes, pair.a_size), (b_ids, pair.b_bytes, pair.b_size)):
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            found = np.cumsum(sizes[flat])
            if b"".join(map(names.__getitem__, flat.tolist())) != b"".join(data) or not np.isin(ends, found).all():
                raise ValueError("a vocabulary does not keep the bytes of a text")
            sides.append((flat, found))
        (a_flat, a_ends), (b_flat, b_ends) = sides
        cuts = np.union1d(a_ends, b_ends)
        self.link_a = a_flat[np.searchsorted(a_ends, cuts)]
        self.link_b = b_flat[np.searchsorted(b_ends, cuts)]
        self.link_ends = np.searchsorted(cuts, ends) + 1  # links up to each segment's end
        groups = np.intersect1d(a_ends, b_ends, assume_unique=True)
        per = lambda at: np.diff(np.searchsorted(at, ends, "right"), prepend=0)
        self.n_a, self.n_b, self.n_groups, self.n_links = per(a_ends), per(b_ends), per(groups), np.diff(self.link_ends, prepend=0)
        self.texts = _group_texts(a_flat, b_flat, np.searchsorted(a_ends, groups) + 1, np.searchsorted(b_ends, groups) + 1, np.searchsorted(groups, ends) + 1)


def _group_texts(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, segment_cuts: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` for each segment."""
    x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups = []
    i = j = 0
    for p, q in zip(a_cuts.tolist(), b_cuts.tolist()):
        groups.append(f"{x[i] if p == i + 1 else ','.join(x[i:p])}|{y[j] if q == j + 1 else ','.join(y[j:q])}")
        i, j = p, q
    out, k = [], 0
    for end in segment_cuts.tolist():
        out.append(";".join(groups[k:end]))
        k = end
    return out


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack_texts(texts: list[bytes]) -> bytes:
    return _packed(b"\xff".join(texts))  # a byte that UTF-8 never has


def _unpack_texts(data: bytes) -> list[bytes]:
    return _unpacked(data).split(b"\xff")


def _pack_ints(*columns: np.ndarray) -> bytes:
    return _packed(np.concatenate([c.astype("<i8") for c in columns]).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_ints(data: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(_unpacked(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").reshape(columns, -1)


def _sorted_parts(segments, parts: int) -> tuple[list[bytes], list[int], list[int]]:
    """Distinct segments by part and in order within it; the parts that have any; and where each begins (and the last ends)."""
    data = sorted(s.encode() for s in segments)
    part = np.fromiter((zlib.crc32(s) % parts for s in data), np.int64, len(data))
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return [data[i] for i in order.tolist()], part[cuts].tolist(), [*cuts.tolist(), len(data)]


_ASKED = "part int, batch long, segments binary, counts binary"
_SUMMED = "part int, texts binary, sizes binary, asked array<struct<batch: long, at: binary>>, a array<int>, b array<int>, links array<long>, link_of binary"
_ANSWER = "batch long, part int, texts binary, numbers binary"
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, least: int = LEAST, keep_groups: bool = False) -> DataFrame:
    """One row for each document: its counts and the digest of its groups; ``keep_groups`` adds the groups themselves."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((file_bytes(a_path), file_bytes(b_path)))
    size = text_bytes(docs, text_col)
    batches, parts = max(least, -(-size // batch_bytes)), max(least, -(-size // part_bytes))
    schema_asked, schema_summed, schema_answer = map(_schema, (_ASKED, _SUMMED, _ANSWER))
    text = column(text_col).cast("string")
    dealt = docs.select(column(id_col).alias("id"), text.alias("text"), F.pmod(F.xxhash64(column(id_col), text), F.lit(batches)).alias("batch"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        pair, found = loaded(*files.value), Counter()
        for t in table.column("text").to_pylist():
            found.update(pair.segments(t))
        data, having, cuts = _sorted_parts(found, parts)
        rows = []
        for p, x, y in zip(having, cuts, cuts[1:]):
            n = np.fromiter((found[s.decode()] for s in data[x:y]), np.int64, y - x)
            rows.append({"part": p, "batch": key[0].as_py(), "segments": _pack_texts(data[x:y]), "counts": _pack_ints(n)})
        return pa.Table.from_pylist(rows, schema=schema_asked)

    def align(key: tuple, table: pa.Table) -> pa.Table:
        asked = [(b.as_py(), _unpack_texts(s.as_py()), _unpack_ints(n.as_py(), 1)[0]) for b, s, n in zip(table.column("batch"), table.column("segments"), table.column("counts"))]
        number: dict[bytes, int] = {}
        places = [np.fromiter((number.setdefault(s, len(number)) for s in segments), np.int64, len(segments)) for _, segments, _ in asked]
        total = np.zeros(len(number), np.int64)
        for at, (_, _, n) in zip(places, asked):
            total[at] += n
        found = loaded(*files.value).align([s.decode() for s in number])
        pairs, link_of = np.unique(found.link_a << 32 | found.link_b, return_inverse=True)
        links = np.zeros(len(pairs), np.int64)
        np.add.at(links, link_of, np.repeat(total, found.n_links))
        row = {
            "part": key[0].as_py(), "texts": _pack_texts([t.encode() for t in found.texts]), "sizes": _pack_ints(found.n_a, found.n_b, found.n_groups, found.n_links),
            "asked": [{"batch": b, "at": _pack_ints(at)} for at, (b, _, _) in zip(places, asked)], "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "links": links, "link_of": _pack_ints(link_of),
        }
        return pa.Table.from_pylist([row], schema=schema_summed)

    def answer(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        pairs = np.asarray(row["a"], np.int64) << 32 | np.asarray(row["b"], np.int64)
        known = counts.column("a").to_numpy().astype(np.int64) << 32 | counts.column("b").to_numpy().astype(np.int64)
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], pairs)]
        n, best = counts.column("count").to_numpy()[at], counts.column("best").to_numpy(zero_copy_only=False)[at]
        sizes, of, texts = _unpack_ints(row["sizes"], 4), _unpack_ints(row["link_of"], 1)[0], _unpack_texts(row["texts"])
        head = np.cumsum(sizes[3]) - sizes[3]
        numbers = np.vstack([sizes, np.add.reduceat(best[of].astype(np.int64), head), np.add.reduceat(n[of], head)])
        rows = []
        for x in row["asked"]:
            mine = _unpack_ints(x["at"], 1)[0]
            rows.append({"batch": x["batch"], "part": row["part"], "texts": _pack_texts([texts[i] for i in mine.tolist()]), "numbers": _pack_ints(*numbers[:, mine])})
        return pa.Table.from_pylist(rows, schema=schema_answer)

    def compose(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        pair, cut = loaded(*files.value), []
        texts = table.column("text").to_pylist()
        distinct: set[str] = set()
        for t in texts:
            distinct.update(pair.segments(t))
        data, _, _ = _sorted_parts(distinct, parts)
        place = {s.decode(): i for i, s in enumerate(data)}
        order = np.argsort(answers.column("part").to_numpy())
        strings = [t.decode() for i in order.tolist() for t in _unpack_texts(answers.column("texts")[i].as_py())]
        numbers = np.hstack([_unpack_ints(answers.column("numbers")[i].as_py(), 6) for i in order.tolist()] or [np.zeros((6, 0), np.int64)])
        if len(strings) != len(data):
            raise ValueError("a batch's answers are not those to what it asked")
        sums, digests, groups = [], [], []
        for t in texts:
            at = [place[s] for s in pair.segments(t)]
            full = ";".join([strings[i] for i in at])
            sums.append(numbers[:, at].sum(axis=1) if at else np.zeros(6, np.int64))
            digests.append(hashlib.sha256(full.encode()).hexdigest() if at else "")
            groups.append(full)
        total = np.array(sums, np.int64).reshape(-1, 6)
        columns = {id_col: table.column("id"), **{c: total[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))}, "groups_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"groups": pa.array(groups, pa.string())} if keep_groups else {}))

    asked = dealt.groupBy("batch").applyInArrow(tidy(ask), _ASKED)
    summed = written(asked.groupBy("part").applyInArrow(tidy(align), _SUMMED), "alignment-parts")
    mine = summed.select(F.col("part").alias("of"), F.explode(F.arrays_zip("a", "b", "links")).alias("x")).select("of", "x.a", "x.b", "x.links")
    counts = mine.groupBy("a", "b").agg(F.sum("links").alias("count"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))
    told = mine.drop("links").join(counts, ["a", "b"])
    answers = summed.drop("links").groupBy("part").cogroup(told.groupBy("of")).applyInArrow(tidy(answer), _ANSWER)
    out = output(docs, {id_col: id_col}, _COUNTS + ", groups string" * keep_groups)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tidy(compose), out)


def op11(spark, sf_dir: str) -> DataFrame:
    """``op11_token_alignment`` over all of ``documents``."""
    from public_tokenizers import path

    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), path(A_FILE), path(B_FILE))
