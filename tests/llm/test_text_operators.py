import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marlspike.llm import decontaminate, digest, mixing

# decontamination


def brute_hits(texts, items, k=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    pats = {}
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            pats.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(p) for p in pats}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in pats:
                    hit.update(range(s, s + n))
                    ids |= pats[tuple(w[s : s + n])]
        out.append((len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def exam(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé1") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 13, 20, 40])))) for i in range(12)]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.6:
            it = rng.choice(items)[1].split()
            a = rng.randrange(len(it) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "!?"]) for x in it[a : a + rng.randint(5, 40)]]
        rows.append((i, "  ".join(w)))
    return rows, items


@pytest.mark.parametrize("size", [1 << 20, 60])
@pytest.mark.parametrize("seed", [4, 7])
def test_contamination_equals_brute_force(spark, frame, edge_rows, size, seed):
    """With the automaton, and with the join for items beyond the limit."""
    rows, items = exam(seed)
    rows += [(100 + k, t) for k, (_, t) in enumerate(edge_rows)]
    table = spark.createDataFrame([*items, (98, None), (99, " -- ")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(frame(rows), table, item_bytes=size).collect()}
    for (i, t), want in zip(rows, brute_hits([t for _, t in rows], items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == want, i
        words = [w for a, b in zip(r.starts, r.ends) for w in decontaminate.words(t[a:b].encode())]
        assert len(words) == r.n_hit


def test_contamination_without_items_or_rows(spark, frame, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(frame(edge_rows), none).collect())
    assert decontaminate.contamination(frame([]), none).collect() == []


def test_item_without_id_hits_words_as_in_sql(spark, frame, tmp_path):
    import duckdb

    rows, items = exam(6)
    passage = " ".join(f"only{k}" for k in range(20))
    items += [(None, passage)]
    rows += [(900, f"before {passage} after")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontaminate.op8(spark, str(tmp_path))
    want = con.execute(decontaminate.ORACLE)
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_scan_equals_brute_force_for_many_lengths():
    rng = random.Random(8)
    for window in (13, 4, 1):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
        items = [(str(i), " ".join(word() for _ in range(n)).encode()) for i, n in enumerate([0, 1, 3, 5, 6, 7, 8, 12, 13, 14, 30, 45])]
        known = decontaminate.Items(items[2:], window)
        texts = [" ".join(word() for _ in range(60)) + " " + rng.choice(items)[1].decode() + " " + word() for _ in range(60)]
        for t, want in zip(texts, brute_hits(texts, [(i, x.decode()) for i, x in items[2:]], window)):
            n, runs, ids = known.scan(t.encode())
            assert (n, sum(b - a for a, b in runs), sorted(ids)) == want[:3]


def test_memory_of_the_automaton_is_bounded():
    """Two megabytes of items of distinct passages take less than 60 bytes of memory for each byte."""
    import subprocess
    import sys

    code = """
import random, resource
from marlspike.llm import decontaminate
rng = random.Random(1)
items = [(str(i), " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(30000)) for _ in range(60)).encode()) for i in range(4500)]
size = sum(len(t) for _, t in items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
known = decontaminate.Items(items)
assert known.scan(items[7][1])[1] == [(0, 60)]
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    size, used = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 1_500_000 and used < 60 * size


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_decontamination_stage(spark, frame, tmp_path, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", size)
    rows, items = exam(5)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(rows)
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = {i for (i, _), b in zip(rows, brute_hits([t for _, t in rows], items)) if not b[3]}
    assert {r.doc_id for r in kept.collect()} == want


# mixing


def brute_seats(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        best = max((v / (2 * s + 1), -i) for i, (v, s) in enumerate(zip(votes, out)))
        out[-best[1]] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sainte_lague_equals_highest_quotients(seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, 1, 7, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 30))]
    seats = rng.randint(0, 400)
    if sum(votes):
        assert mixing.sainte_lague(votes, seats).tolist() == brute_seats(votes, seats)


def test_targets_are_capped_and_shared_again():
    got = mixing.targets([100, 1000, 10], [5, 2, 1])
    assert got[0] == 200 and got[2] == 20 and math.isclose(sum(got), 1.5 * 1110)
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == [0.0, 7.5]


def test_small_sources_get_their_share(frame):
    rows = [(k, " ".join(["w"] * 5), f"s{k // 4:03d}") for k in range(1200)]  # 300 sources of 20 words
    rows += [(5000 + k, "x " * 2000, "t") for k in range(20)] + [(9000, "one", "u"), (9001, "", "v")]
    got = mixing.mix(frame(rows), shard_docs=2).collect()
    source, taken, target = {r[0]: r[2] for r in rows}, {}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= max(1, 0.01 * t) for s, t in target.items()), [(s, taken[s], t) for s, t in target.items()][:5]
    few = mixing.mix(frame([(k, "a b c d e f g h i j", f"s{k}") for k in range(3)])).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in few)


def test_quotas_under_caps():
    assert mixing.quotas([10, 10, 10], [5, 100, 100], 30, 1).tolist() == [5, 13, 12]  # what the cap cuts off goes to the others
    assert mixing.quotas([1, 2], [2, 4], 6, 4).tolist() == [2, 4] and mixing.quotas([0, 0], [9, 9], 5, 1).tolist() == [0, 0]
    assert mixing.block_size([0, 30.0], 64) == 1 and mixing.block_size([6400.0, 1e9], 64) == 64 and mixing.block_size([], 64) == 1


def test_mix_meets_targets(frame, edge_rows):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(900)]
    rows += [(1000 + k, t, "edge") for k, (_, t) in enumerate(edge_rows)] + [(None, "x y z", "a")]
    got = mixing.mix(frame(rows), shard_docs=50).collect()
    assert len(got) == len(rows)
    again = mixing.mix(frame(rows), shard_docs=50).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    source = {r[0]: r[2] for r in rows}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, taken[s], t)
    assert mixing.mix(frame([])).collect() == []


def test_shared_ids_are_spread_over_bounded_shards(frame):
    rows = [(None, " ".join(f"w{i}" for _ in range(20)), "a") for i in range(600)]
    got = mixing.mix(frame(rows), shard_docs=10, max_shards=12).collect()
    held = Counter(r.shard for r in got)
    assert len(held) == 12 and max(held.values()) < 120
    assert abs(sum(r.taken for r in got) - got[0].target) <= mixing.BLOCK_WORDS and got[0].target == 1.5 * 12_000
    assert [mixing.shards_for(n, 10, 12) for n in (0, 1, 10, 11, 120, 121, 10**9)] == [0, 1, 1, 2, 12, 11, 12]


# digests


def test_entropy_bins_equal_direct_entropy():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"aaaabcdefgh  eett", np.uint8), 700)
    bins = digest.entropy_bins(data)
    for p in range(0, len(bins), 13):
        c = np.bincount(data[p : p + digest.WINDOW])
        q = c[c > 0] / digest.WINDOW
        assert abs(bins[p] - -(q * np.log2(q)).sum() / 5 * (digest.BINS - 1)) < 2


def brute_filters(text, rank):
    """The digest of a text, byte by byte: number of features, and filters as sets of bits with their numbers of features."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    data = text.encode()
    features = []
    if data:
        windows = max(1, len(data) - 31)
        span = 1 << min(6, int(math.log2(max(1, windows // 8))))
        padded = data.ljust(32, b"\0")
        ranks = rank[digest.entropy_bins(np.frombuffer(padded, np.uint8))].tolist()
        marked = Counter(min(range(i, i + span), key=lambda p: (ranks[p], p)) for i in range(len(ranks) - span + 1))
        for p in sorted(p for p, n in marked.items() if n >= span / 4):
            h = 0
            for k in range(0, 32, 8):
                h = mix(h * 0x9E3779B97F4A7C15 + int.from_bytes(padded[p + k : p + k + 8], "little") & m)
            features.append(h)
    if 0 < len(data) < 96:
        short = data.ljust(8, b"\0")
        features += [mix(int.from_bytes(short[p : p + 8], "little") + 8 & m) for p in range(len(short) - 7)]
    features = list(dict.fromkeys(features))
    filters = [features[k : k + 160] for k in range(0, len(features), 160)]
    return len(features), [({f >> 11 * k & 2047 for f in some for k in range(5)}, len(some)) for some in filters]


def brute_text(count, filters):
    import base64

    data = b"".join(bytes(sum(128 >> k for k in range(8) if 8 * i + k in bits) for i in range(256)) for bits, _ in filters)
    return f"id1:{count}:" + base64.b64encode(data).decode()


def brute_likeness(a, b):
    if a[0] == b[0] and [x for x, _ in a[1]] == [x for x, _ in b[1]]:
        return 1.0
    if (len(a[1]), a[0]) > (len(b[1]), b[0]):
        a, b = b, a
    if not a[1]:
        return 0.0
    best = [max((len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9) for y, _ in b[1]) for x, _ in a[1]]
    return sum(min(1, max(0, v)) * n for v, (_, n) in zip(best, a[1])) / sum(n for _, n in a[1])


def test_digest_query_equals_brute_force(spark, small_dir):
    """Every column of the query for every document of the small table."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rank = digest.rarity(docs)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    counts = np.zeros(digest.BINS, np.int64)
    for _, t in rows:
        if len(t.encode()) >= 32:
            counts += np.bincount(digest.entropy_bins(np.frombuffer(t.encode(), np.uint8)), minlength=digest.BINS)
    order = sorted(range(digest.BINS), key=lambda b: (b < digest.LOW_ENTROPY * digest.BINS, counts[b], b))
    assert [int(rank[b]) for b in order] == list(range(digest.BINS))
    got = {r.doc_id: r for r in digest.op1(spark, small_dir).collect()}
    assert len(got) == len(rows)
    made = [brute_filters(t, rank) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        after = (k + 1) % len(rows)
        edit = t[: len(t) - len(t) // 4] + rows[after][1][: len(t) // 4]
        changed = brute_filters(edit, rank)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edit.encode()).hexdigest(), brute_text(*made[k]), brute_text(*changed)), i
        assert abs(r.near_edited - brute_likeness(made[k], changed)) < 1e-9 and abs(r.near_next - brute_likeness(made[k], made[after])) < 1e-9


def test_digests_of_ids_that_are_texts(spark):
    rng = random.Random(9)
    rows = [(f"http://{'aé漢😀'[i % 4]}/{rng.randrange(10**6)}", " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 300)))) for i in range(300)]
    got = {r.doc_id: r for r in digest.digests(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), batch_bytes=2000).collect()}
    rows.sort()
    for k, (i, t) in enumerate(rows):
        edit = digest.edited(t, rows[(k + 1) % len(rows)][1])
        assert got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()


def test_digests_of_all_rows(frame, edge_rows):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randint(1, 8))) for _ in range(n))
    rows = [(20 + 3 * i, text(rng.randint(20, 600))) for i in range(60)] + [r for r in edge_rows if r[0] is not None and r[0] != 6] + [(6, "The same text, twice over.")]
    got = {r.doc_id: r for r in digest.digests(frame(rows)).collect()}
    ordered = sorted(rows)
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + nxt[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if got[i].fingerprint == got[ordered[(k + 1) % len(ordered)][0]].fingerprint:
            assert got[i].near_next == 1
    assert got[6].fingerprint == got[7].fingerprint and got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == got[5].fingerprint
    own = [r for i, r in got.items() if i >= 20]
    assert min(r.near_edited for r in own) > 0.4 and np.mean([r.near_next for r in own]) < 0.15


def test_digest_edge_cases(frame, edge_rows):
    got = digest.digests(frame(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    alone = digest.digests(frame([(5, "a text that stands alone, but long enough for windows")])).collect()[0]
    assert alone.near_next == 1
    assert digest.digests(frame([])).collect() == []
