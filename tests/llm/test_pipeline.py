import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from marlspike.llm import mixing
from test_duplicates import brute_components, brute_print, brute_repeats
from test_text_operators import brute_hits


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with toxic texts, near copies, a repeated passage and a benchmark passage."""
    d = tmp_path_factory.mktemp("planted")
    rng = random.Random(9)
    words = ["".join(rng.choice("aeionrstl") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = text(70), text(30)
    rows, labels = [], []
    for i in range(240):
        body, toxic = text(rng.randint(60, 200)), 0
        if i % 6 == 0:
            body, toxic = f"{body} {rng.choice(['zakkepuk', 'grumblewit'])} {text(5)}", 1
        elif i % 10 == 1:
            body = f"{body}\n{passage}\n{text(10)}"
        elif i % 40 == 7:
            body = item + " " + text(20)
        elif i % 40 == 9:
            body, toxic = rows[i - 1][1], labels[i - 1][2]
        rows.append((i, body, "en", f"src{i % 4}", len(body)))
        labels.append((i, 1, toxic))
    rows.append((240, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(40))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, labels, item


def test_every_stage_equals_its_brute_force_version(spark, planted):
    d, rows, labels, item = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    docs = stages["toxicity"](spark, docs, d).cache()
    assert docs.columns == columns
    toxic = {i for i, _, y in labels if y}
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows} - toxic

    kept = sorted((r.doc_id, r.text) for r in docs.collect())
    ids = [(i, brute_print(t)) for i, t in kept]
    heads = set(brute_components(ids))
    docs = stages["near duplicates"](spark, docs, d).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == heads and len(heads) < len(kept)

    kept = [(i, t) for i, t in kept if i in heads]
    sizes = {i: b[0] - b[1] for (i, _), b in zip(kept, brute_repeats(kept))}
    docs = stages["repeated passages"](spark, docs, d).cache()
    assert docs.columns == columns and {r.doc_id: len((r.text or "").encode()) for r in docs.collect()} == sizes
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())

    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    hits = brute_hits([t for _, t in texts], [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()])
    clean = {i for (i, _), h in zip(texts, hits) if not h[3]}
    docs = stages["benchmark contamination"](spark, docs, d).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == clean and len(clean) < len(texts)

    mixed = stages["source mix"](spark, docs, d).collect()
    assert {r.doc_id for r in mixed} == clean
    by = {}
    for r in docs.collect():
        by[r.source] = by.get(r.source, 0) + len((r.text or "").split())
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([by[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))])))
    source = {r.doc_id: r.source for r in docs.collect()}
    for s in names:
        taken = sum(r.taken for r in mixed if source[r.doc_id] == s)
        assert abs(taken - goals[s]) <= max(2, 0.02 * goals[s])


def test_run_is_the_stages_in_order_and_registered(spark, planted):
    d = planted[0]
    got = sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, d).collect())
    assert got == sorted((r.doc_id, r.taken) for r in entry.queries()["pipeline"](spark, d).collect())
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}


def test_empty_documents(spark, planted, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
