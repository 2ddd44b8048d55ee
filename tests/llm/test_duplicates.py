import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.llm import shared, simhash, suffixes


def brute_repeats(rows, length=100):
    """(bytes, removed, runs, sha) for rows in corpus order."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, np.int64)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages(seed, docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(0, 8)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))))
        rows.append((i, " ".join(parts)))
    rows += [(docs, "ab" * 400), (docs + 1, "x" * 333), (docs + 2, rows[3][1]), (docs + 3, rows[3][1] + "!")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(frame, seed):
    rows = passages(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(frame(rows)).collect()}
    for (i, _), want in zip(rows, brute_repeats(rows)):
        assert got[i] == want, i


def test_repeats_edge_cases(frame, edge_rows):
    got = suffixes.repeats(frame(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = sorted((str(r[0]), *w) for r, w in zip(order, brute_repeats(order)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("piece", [150, 1000])
def test_texts_in_pieces_equal_brute_force(frame, edge_rows, piece):
    rows = passages(7) + [(200 + i, t) for i, t in edge_rows if i is not None and i != 4 and i != 5] + [(300, ("über " * 90 + "x" * 120) * 3), (300, ("über " * 90 + "x" * 120) * 3)]
    got = suffixes.repeats(frame(rows), carry=["lang"], keep_text=True, batch_bytes=1100, piece_bytes=piece, max_ranges=3).collect()
    order = sorted(rows, key=lambda r: r[0])
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i, *w) for (i, _), w in zip(order, brute_repeats(order)))
    assert {r.row.lang for r in got} == {"en"} and all((r.kept is None) == (r.doc_id == 201) for r in got)
    for r in got:
        edges = [0, *(x for pair in zip(r.starts, r.ends) for x in pair), r.n_bytes]
        assert edges == sorted(edges) and sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed


def test_one_text_of_64_mb(spark):
    half = np.random.default_rng(1).integers(97, 123, 32 << 20, dtype=np.uint8).tobytes()
    docs = spark.createDataFrame([(1, "short"), (2, (half + half).decode())], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.repeats(docs).collect()}
    assert (got[2].n_bytes, got[2].n_removed, got[2].starts, got[2].ends) == (64 << 20, 32 << 20, [32 << 20], [64 << 20])
    assert got[2].kept_sha256 == hashlib.sha256(half).hexdigest() and got[1].n_removed == 0


def test_repeats_with_ids_that_are_texts_or_repeat(spark):
    rows = [(f"{'aé漢😀'[i % 4]}{i:03d}", t) for i, t in passages(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(docs, batch_bytes=500).collect()}
    rows.sort()
    assert [got[i] for i, _ in rows] == brute_repeats(rows)
    # one id, or none, for all rows: many batches all the same, in order of the texts' hashes
    for kind, value in (("string", "x"), ("bigint", None)):
        docs = spark.createDataFrame([(value, t) for _, t in rows], f"doc_id {kind}, text string")
        marked = sorted((r.m, r.text) for r in docs.selectExpr("xxhash64(coalesce(text, '')) m", "text").collect())
        found = suffixes.repeats(docs, batch_bytes=500).collect()
        assert sorted(r.n_removed for r in found) == sorted(w[1] for w in brute_repeats(marked))
        ranges = shared.Ranges(docs, "doc_id", "text", 50, 50 * 500)
        assert docs.select(ranges.number().alias("n")).distinct().count() > 10


@pytest.mark.parametrize("most", [1, 3])
def test_ranges_of_several_batches(frame, edge_rows, most):
    rows = passages(8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(frame(rows), batch_bytes=700, max_ranges=most).collect()}
    assert [got[i] for i, _ in rows] == brute_repeats(rows)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = suffixes.repeats(frame(edge_rows), batch_bytes=700, max_ranges=most).collect()
    want = sorted((str(r[0]), *w) for r, w in zip(order, brute_repeats(order)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want


def test_cut_ranges_follow_the_order(spark):
    rows = [(k % 4, i, "y" * (i % 90), i % 3) for k in range(4) for i in range(200)]
    cut = suffixes.cut_ranges(spark.createDataFrame(rows, "_batch long, doc_id long, _text string, _mark long"), "doc_id", 500)
    found = cut.groupBy("_batch").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum(F.octet_length("_text")).alias("n")).orderBy("_batch").collect()
    assert len(found) > 60 and max(r.n for r in found) < 500 + 90
    assert all(x.b < y.a for x, y in zip(found, found[1:]) if x["_batch"] >> 32 == y["_batch"] >> 32)


def test_ranges_have_similar_bytes(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * (rng.randint(0, 50) if i % 10 else 4000)) for i in range(3000)], "doc_id long, text string")
    size = shared.text_bytes(docs)
    ranges = shared.Ranges(docs, "doc_id", "text", 20, size)
    rows = docs.selectExpr("*", "octet_length(text) n").withColumn("r", ranges.number()).groupBy("r").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first")).orderBy("r").collect()
    assert 15 <= len(rows) <= 25 and max(r.n for r in rows) < 3 * size / 20
    assert [r["first"] for r in rows] == sorted(r["first"] for r in rows)


def test_repeats_of_an_empty_table(frame):
    assert suffixes.repeats(frame([])).collect() == []


def test_many_runs_for_one_gram(frame):
    """One q-gram in more different runs than a batch sends."""
    rng = random.Random(5)
    core = "".join(rng.choice("abcdefgh") for _ in range(80))
    noise = lambda: "".join(rng.choice("mnopqrst") for _ in range(60))
    rows = [(i, noise() + core + noise()) for i in range(30)]
    rows += [(30 + i, rows[i][1][20:180] + noise()) for i in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeats(frame(rows), batch_bytes=1000).collect()}
    for (i, _), want in zip(rows, brute_repeats(rows)):
        assert got[i] == want, i


def test_whole_characters_only():
    text = "aé" * 4
    data = text.encode()
    assert suffixes.without_characters(data, [2], [5]) == "aé" + text[3:]
    assert suffixes.without_characters(data, [0], [len(data)]) == ""
    assert suffixes.without_characters(data, [1], [2]) == text


def test_stage_takes_repeats_out_and_keeps_columns(spark, frame):
    passage = "a passage of many words " * 8
    docs = frame([(1, passage + "one"), (2, "two " + passage), (3, None)])
    got = {r.doc_id: r for r in suffixes.stage(spark, docs, "").collect()}
    assert suffixes.stage(spark, docs, "").columns == docs.columns
    assert len(got[2].text) < 40 and got[2].n_chars == len(got[2].text)
    assert got[3].text is None and got[3].n_chars is None


# SimHash


def brute_print(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    count = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_components(items, radius=4):
    """Least id of each item's component; items are (id, fingerprint)."""
    label = list(range(len(items)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(items))]


def test_fingerprint_of_many_shingles():
    text = " ".join(f"w{i % 91}x{i % 7}" for i in range(3000)).upper()
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == brute_print(text)


def test_groups_edge_cases(frame, edge_rows):
    items = [(d, brute_print(t)) for d, t in edge_rows]
    want = sorted((str(d), f, str(c)) for (d, f), c in zip(items, brute_components(items)))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in simhash.groups(frame(edge_rows)).collect())
    assert got == want
    assert simhash.groups(frame([])).collect() == []


def check_links(spark, prints, **how):
    """Components of ``link_edges`` are those of all pairs."""
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(simhash.link_edges(nodes, len(prints), **how)).collect()}
    groups = {}
    for (_, p), c in zip(enumerate(prints), brute_components(list(enumerate(prints)))):
        groups.setdefault(c, set()).add(p)
    for members in groups.values():
        assert len({roots.get(p, p) for p in members}) == 1
    assert len({roots.get(p, p) for p in prints}) == len(groups)


def some_prints(seed, centres=60, near=4):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(centres)}
    for x in list(prints):
        for _ in range(near):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(x)
    return prints


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_links_equal_all_pairs(spark, m):
    check_links(spark, some_prints(m), m=m)


@pytest.mark.parametrize("m", [2, 5])
def test_heavy_parts_are_shared_out(spark, m):
    """Many near copies of one text, small parts and shares of a few rows."""
    check_links(spark, some_prints(m, 3, 80), m=m, part_rows=2, heavy_rows=5)


def test_long_ranges_skip_known_groups(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 2)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 7)
    for seed in range(12):
        rng = random.Random(seed)
        prints = sorted({x & ~0xFFF | 0x5A5 for x in some_prints(seed, 8, 12)})  # one value in the segment that is looked up
        rng.shuffle(prints)
        fp = np.array(prints, np.uint64)
        label = simhash._part_links(fp, np.zeros(len(fp), np.uint64), np.ones(len(fp), bool), 0, 12, 4, 4, 0)
        want = brute_components(list(enumerate(prints)))
        assert len({*zip(label.tolist(), want)}) == len(set(want)) == len(set(label.tolist()))


def test_part_counts_follow_the_fingerprints():
    assert [simhash.prefix_bits(n, 32) for n in (10, 10**6, 2 * 10**10)] == [4, 10, 24]
    assert simhash.prefix_bits(10**12, 12) == 12


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(edges, rounds=2)


def test_table_choice_is_cheapest_of_exact_ones():
    assert simhash.tables_for(1000) == 5
    assert simhash.tables_for(250_000) == 3
    assert simhash.tables_for(10**11) == 2


def test_stage_keeps_one_of_each_group(spark, frame, edge_rows):
    docs = frame(edge_rows)
    got = simhash.stage(spark, docs, "")
    assert got.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids.count("6") == 1 and "7" not in ids and "5" not in ids and "None" in ids
