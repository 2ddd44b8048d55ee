import itertools
import random
import zlib

import numpy as np
import pytest

from marlspike.llm import quality, toxicity


def brute_kernel(s, t, p, decay):
    return sum(decay ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a in itertools.combinations(range(len(s)), p) for b in itertools.combinations(range(len(t)), p) if [s[i] for i in a] == [t[j] for j in b])


@pytest.mark.parametrize("pair", [("idiot", "id.iot"), ("abcabc", "aabbcc"), ("xyz", "abc"), ("loser", "closer")])
def test_subsequence_kernel(pair):
    got = toxicity.subsequences(toxicity._codes([pair[0]]), toxicity._codes([pair[1]]))[:, 0]
    assert np.allclose(got, [brute_kernel(*pair, p, toxicity.DECAY) for p in toxicity.ORDERS], rtol=1e-4)


def talk(seed, n, bad_words):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        y = int(rng.random() < 0.2)
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(bad_words))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, frame):
    rows, labels = talk(1, 800, ["grumblewit", "zakkepuk", "mufflehead"])
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, ys = toxicity.labelled(docs, marks, "toxic", toxicity.HELD_OUT, 10_000)
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    model = toxicity.train(texts, ys)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(scores[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.97
    hidden = model.scores(["so g r u m b l e w i t said", "you z-a-k-k-e-p-u-k there", "mufflexhead again", "tea on sort"])
    assert min(hidden[:3]) > 0.5 > hidden[3]


def test_every_insult_of_a_large_vocabulary_is_learned():
    rng = random.Random(7)
    bad_words = ["".join(rng.choice("bcdfghjklmpquvwxyz") for _ in range(rng.randint(7, 10))) for _ in range(40)]
    rows, labels = talk(4, 4000, bad_words)
    model = toxicity.train([t for _, t in rows], [y for _, _, y in labels])
    texts = [f"tea on sort {w} tea" for w in bad_words]
    assert min(model.scores(texts)) > 0.5 > max(model.scores(["tea on sort tea"]))


def test_gapped_insults_are_one_segment():
    assert "idiot" in toxicity.segments("an i - d - i - o - t indeed")
    assert "stupid" in toxicity.segments("very s . t . u . p . i . d thing")
    assert "stupid" in toxicity.segments("very st up id thing") and "stupid" in toxicity.segments("very st - u.p * id. thing")
    rows, labels = talk(1, 800, ["grumblewit", "zakkepuk", "mufflehead"])
    model = toxicity.train([t for _, t in rows], [y for _, _, y in labels])
    hidden = model.scores(["tea g - r - u - m - b - l - e - w - i - t sort", "tea z . a . k . k . e . p . u . k sort", "tea mu ff le he ad sort", "tea so rt"])
    assert min(hidden[:3]) > 0.5 > hidden[3]


def test_closest_clean_words_are_landmarks_however_many_there_are():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeionrst") for _ in range(9)) for _ in range(400)) for _ in range(150)]
    near = ["grumblewig", "grumblewif", "grumblewib", "grumblewix", "grumblewiz"]
    texts[7] += " " + " ".join(near)
    bad = [f"{' '.join(t.split()[:9])} grumblewit" for t in texts[:40]]
    model = toxicity.train([*texts, *bad], [0] * len(texts) + [1] * len(bad))
    assert len({w for t in texts for w in toxicity.segments(t)}) > 50_000 and set(near) <= set(model.landmarks.words)


def test_insults_of_several_words_are_learned():
    """A phrase of words that also occur alone in clean texts, seen on held-out texts, with gaps and inserted characters."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(3, 8))) for _ in range(300)] + ["total", "waste", "space"]
    rows = []
    for i in range(1000):
        w = [rng.choice(words) for _ in range(40)]
        y = int(i % 4 == 0)
        for x in ["total", "waste", "space"]:  # each alone in clean texts too
            w.insert(rng.randrange(len(w)), x)
        if y:
            at = rng.randrange(len(w))
            w[at:at] = ["total", "waste", "space"]
        rows.append((" ".join(w), y))
    model = toxicity.train([t for t, _ in rows[:700]], [y for _, y in rows[:700]])
    held = [(s >= 0.5) == y for s, (_, y) in zip(model.scores([t for t, _ in rows[700:]]), rows[700:])]
    assert np.mean(held) > 0.97
    hidden = model.scores(["tea total w-a-s-t-e space tea", "tea tot.al waste of space tea", "tea total wasste spa*ce", "space tea total tea tea waste"])
    assert min(hidden[:3]) > 0.5 > hidden[3]


def test_learned_texts_are_bounded_in_bytes(spark, frame):
    rows = [(i, "word " * (1 + i % 50)) for i in range(200)] + [(7, "word " * 8), (300, None)]
    marks = spark.createDataFrame([(i, i % 2) for i in [*range(200), 300, 301]], "doc_id long, toxic int")
    texts, ys = toxicity.labelled(frame(rows), marks, "toxic", toxicity.HELD_OUT, 10_000, most_bytes=2000)
    assert 1700 < sum(map(len, texts)) <= 2000 and len(texts) == len(ys)
    assert toxicity.labelled(frame(rows), marks, "toxic", toxicity.HELD_OUT, 30)[1:] and len(toxicity.labelled(frame(rows), marks, "toxic", toxicity.HELD_OUT, 30)[0]) <= 30
    assert toxicity.labelled(frame([]), marks, "toxic", toxicity.HELD_OUT, 30) == ([], [])


def test_toxicity_edge_cases(spark, frame, edge_rows):
    model = toxicity.train([], [])
    got = toxicity.score(frame(edge_rows), model).collect()
    assert len(got) == len(edge_rows) and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1
    assert toxicity.score(frame([]), model).collect() == []
    rows, labels = talk(2, 300, ["grumblewit"])
    model = toxicity.train([t for _, t in rows], [y for _, _, y in labels])
    got = {r.doc_id: r.score for r in toxicity.score(frame(edge_rows), model).collect()}
    assert len(got) == len({r[0] for r in edge_rows}) and got[1] == got[2] == got[8] and got[6] == got[7]
    assert all(len(s) <= toxicity.LONGEST for s in toxicity.segments("a b c " * 500 + "y" * 999))


def test_toxicity_stage_drops_what_it_predicts(spark, frame, tmp_path):
    rows, labels = talk(3, 400, ["grumblewit"])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(rows)
    kept = toxicity.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i not in ids) == (y == 1) for i, _, y in labels]) > 0.97


def junk(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 120))]
        kind = rng.random()
        text = " ".join(w) + "."
        if kind < 0.1:
            text = " ".join(x.upper() + "!!" for x in w)
        elif kind < 0.2:
            text = " | ".join(w)
        elif kind < 0.3:
            text = " ".join([w[0]] * 80)
        rows.append((i, text))
        labels.append((i, int(kind >= 0.3), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark, frame):
    rows, labels = junk(1, 800)
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(scores[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.7) == (y == 1) for s, y in held]) > 0.97
    assert 0 < len(model.rules) < 80
    measured = quality.measured(docs.selectExpr("doc_id", "text"), "text", ["doc_id"]).toPandas().sort_values("doc_id")
    want = model.predict(measured[quality.STATISTICS].to_numpy(float))
    assert np.allclose(want, [scores[i] for i in measured["doc_id"]])


def test_quality_edge_cases(spark, frame, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(frame(edge_rows), none)
    assert [round(r.score, 6) for r in quality.score(frame(edge_rows), model).collect()] == [0.5] * len(edge_rows)
    rows, labels = junk(2, 300)
    model = quality.fit(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.score(frame(edge_rows), model).collect()}
    assert got[1] == got[2] and got[6] == got[7] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(frame([]), model).collect() == []


def brute_statistics(text):
    """The statistics of a text, counted in Python."""
    import math
    import re
    import unicodedata

    text = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    counts = {"n": len(text), "count": len(words)}
    share = lambda a, b: a / counts[b] if counts[b] else 0.0
    out = [math.log1p(len(words)), share(len(text), "count"), share(len(set(words)), "count"), share(sum(unicodedata.category(c) == "Lu" for c in text), "n")]
    return out + [share(len(re.findall(p, text)), by) for p, by in quality.COUNTED.values()]


def test_quality_query_equals_rules_in_python(spark, small_dir):
    """Every row of the query: statistics counted and rules applied in Python."""
    docs, labels = (spark.read.parquet(f"{small_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    want = model.predict(np.array([brute_statistics(r.text) for r in rows]))
    got = {r.doc_id: r for r in quality.op5(spark, small_dir).collect()}
    assert len(got) == len(rows) and len(model.rules) > 0
    for r, w in zip(rows, want):
        g = got[r.doc_id]
        assert abs(g.score - w) < 1e-9 and g.predicted == int(g.score >= 0.7) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        total = model.bias
        for rule, weight in model.rules:
            x = brute_statistics(r.text)
            total += weight * all((x[f] > v) if above else (x[f] <= v) for f, v, above in rule)
        assert abs(1 / (1 + np.exp(-total)) - w) < 1e-9


def test_lasso_weights_meet_their_optimality_conditions():
    rng = np.random.default_rng(2)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (r[:, 0] + r[:, 3] * 2 - r[:, 5] + rng.normal(0, 0.7, 400) > 0.8).astype(float)
    for strength in (0.05, 0.01):
        w, bias = quality.lasso(r, y, strength, 20_000)
        slope = r.T @ (1 / (1 + np.exp(-(r @ w + bias))) - y) / len(y)
        assert np.allclose(slope[w != 0], -strength * np.sign(w[w != 0]), atol=1e-4) and (np.abs(slope[w == 0]) <= strength + 1e-4).all()
        assert abs((1 / (1 + np.exp(-(r @ w + bias))) - y).mean()) < 1e-4
    assert (quality.lasso(r, y, 0.5)[0] == 0).all()


def test_rules_are_paths_of_trees():
    rng = np.random.default_rng(3)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    rules = quality.grow_rules(x, y)
    assert all(1 <= len(rule) <= quality.DEPTH for rule in rules) and len({tuple(r) for r in rules}) == len(rules)
    best = min(np.abs(quality.holds(rules, x) - y[:, None]).mean(axis=0))
    assert best < 0.03  # the planted conjunction is among them
