"""Alignment and byte-pair encoding against the tokenizers' own libraries on whole texts."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from marlspike.llm import alignment, bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(5)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return [
        None, "", " ", "\n", "  \n\t ", "a", "Plain words, and more words.", "a<|endoftext|>b <|startoftext|> <s> </s> <unk> <0x41> |", "it's I'LL 'S don’t we've", "x▁y z", "▁", "end \r\n next\r line;\r\r x \x0b\x0c y\x85z",
        "tabs\t\tand  two   spaces ", "ﬁ Å ΑΣ İ ß é ́ Ǆ Ⱥ \x1c \x1f K ſt", "日本語　の文。 русский текст 🙂👩‍👩‍👧 \x00 ", "a" * 3000, "ab" * 700 + " the the " + "c" * 400, of("thequickbrownfox", 5000), of("abcdeé ﬁ世界0123\n\t🙂'.,", 3000), "1234567890 " * 30, "x" + " " * 40 + "y", "word " * 3000,
    ]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.B_FILE))


def brute_alignment(texts):
    """The seven columns of each text: whole texts tokenised, tokens compared pair by pair along the bytes."""
    pair = alignment.Pair(bpe.file_bytes(P.path(alignment.A_FILE)), bpe.file_bytes(P.path(alignment.B_FILE)))
    a, b = encoders()
    found, count = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(pair.a_bytes[i] for i in x) != whole or b"".join(pair.b_bytes[i] for i in y) != whole:
            found.append(None)
            continue
        links, groups, i, j, p, q, ga, gb = [], [], 0, 0, len(pair.a_bytes[x[0]]), len(pair.b_bytes[y[0]]), [x[0]], [y[0]]
        while True:
            links.append((x[i], y[j]))
            if p == q:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                i, j = i + 1, j + 1
                if i == len(x):
                    break
                p, q, ga, gb = p + len(pair.a_bytes[x[i]]), q + len(pair.b_bytes[y[j]]), [x[i]], [y[j]]
            elif p < q:
                i += 1
                p += len(pair.a_bytes[x[i]])
                ga.append(x[i])
            else:
                j += 1
                q += len(pair.b_bytes[y[j]])
                gb.append(y[j])
        count.update(links)
        found.append((len(x), len(y), links, groups))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[3]), len(f[2]), sum(count[k] == best[k[1]] for k in f[2]), sum(count[k] for k in f[2]), digest(";".join(f[3]))) for f in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(frame, spark):
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[6]), (6, texts[6]), (None, texts[8])]
    docs = frame(rows).withColumnRenamed("score", "segments").withColumnRenamed("size", "texts")
    got = alignment.aligned(docs, P.path(alignment.A_FILE), P.path(alignment.B_FILE), least=3)
    want = brute_alignment([t for _, t in rows])
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got.collect()) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), P.path(alignment.A_FILE), P.path(alignment.B_FILE), least=2).collect() == []


def test_alignment_query_equals_brute_force_on_whole_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_alignment([r.text for r in docs])
    assert sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.op11(spark, small_dir).collect()) == sorted((r.doc_id, *w) for r, w in zip(docs, want))


def test_cuts_are_only_where_no_token_joins_across():
    assert alignment.safe_space(["ab", " a", ";\r", "  "]) == "".join(c for c in alignment._all_space() if c != "\r")
    pair = alignment.Pair(bpe.file_bytes(P.path(alignment.A_FILE)), bpe.file_bytes(P.path(alignment.B_FILE)))
    assert pair.segments("a b;\r c\n\nd \re") == [" a", " b;\r c", "\n\nd", " \re"]
    assert pair.segments(None) == pair.segments("") == pair.segments("x▁ y") == []
    a, b = encoders()
    for t in odd_texts():
        if segments := pair.segments(t):
            assert "".join(segments) == " " + t
            assert [i for s in segments for i in pair.a.encode(s, add_special_tokens=False).ids] == a.encode(" " + t, add_special_tokens=False).ids
            assert [i for s in segments for i in pair.b.encode(s)] == b.encode(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_the_library(frame, spark, name):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(P.path(name)), [(k, t) for k, t in enumerate(odd_texts())] + [(6, odd_texts()[6]), (None, "no id")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), digest(" ".join(map(str, ids))), digest(text), ids, text))
    got = bpe.encoded(frame(rows).withColumnRenamed("score", "ids"), P.path(name), with_ids=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got) == sorted(want)
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), P.path(name)).collect() == []


def test_codec_query_equals_the_library_on_whole_table(spark, small_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(bpe.VOCABULARY))
    want = []
    for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.op13(spark, small_dir).collect()) == sorted(want)


def test_every_code_point_of_two_planes_is_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path(bpe.VOCABULARY)), bpe.Vocabulary(bpe.file_bytes(P.path(bpe.VOCABULARY)))
    points = [f"a{chr(c)}b1 {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" | ".join(points[k : k + 400]) for k in range(0, len(points), 400)]
    assert own.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_merge_rounds_equal_one_merge_at_a_time():
    rng = np.random.default_rng(3)
    made, left, right = 4, [], []
    pairs = set()
    while made < 40:  # random rules over symbols that are there by then
        pair = (int(rng.integers(0, made)), int(rng.integers(0, made)))
        if pair not in pairs:
            pairs.add(pair)
            left.append(pair[0])
            right.append(pair[1])
            made += 1
    merges = bpe.Merges(np.array(left), np.array(right), np.arange(4, 40))
    rank = {p: r for r, p in enumerate(zip(left, right))}

    def plain(word):
        word = list(word)
        while found := [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]:
            r, i = min(found)
            word[i : i + 2] = [4 + r]
        return word

    words = [rng.integers(0, 4 if k % 2 else 2, rng.integers(1, 12 if k % 10 else 900)).tolist() for k in range(300)]
    flat, counts = merges.apply(np.array([s for w in words for s in w], np.int32), np.array([len(w) for w in words]))
    cuts = np.cumsum(counts)[:-1]
    assert [x.tolist() for x in np.split(flat, cuts)] == [plain(w) for w in words]
    with pytest.raises(ValueError):
        bpe.Merges(np.array([2, 0]), np.array([0, 1]), np.array([3, 2]))  # merged before it is made
