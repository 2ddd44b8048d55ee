"""Queries over more rows than the given small tables have, against DuckDB."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.operators import batches, cells, chunking, embedding, latent, ranking
from marlspike.plans import catalog
from marlspike.settings import Settings
from marlspike.sources import files


@pytest.fixture(scope="module")
def wide_dir(spark, tmp_path_factory):
    """4,000 vectors with texts: 2,000 of label 1, 2,000 of source src3."""
    d, i = str(tmp_path_factory.mktemp("wide")), F.col("id")
    wave = lambda k: F.sin(i * F.lit(0.7 + k) + F.lit(float(k))).cast("float")
    spark.range(4000).select(i.alias("vec_id"), F.array(*[wave(k) for k in range(8)]).alias("embedding"), (i % 2).cast("int").alias("label")).write.parquet(f"{d}/embeddings.parquet")
    text = F.when(i % 9 == 0, F.lit("short")).otherwise(F.concat(F.lit("a text with letters enough to count "), i.cast("string")))
    spark.range(4000).select(i.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.when(i % 2 == 1, 3).otherwise(i % 3)).alias("source")).write.parquet(f"{d}/documents.parquet")
    return d


def same(spark, d, name, tables=("embeddings", "documents")):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, d)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"select {columns} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


BOOSTED = [
    "amplification_probabilities",
    "marked_positions",
    "sampled_shares",
    "boosted_all_scores",
    "boosted_topk",
    "retrieve_envelope",
    "scoped_retrieve",
]


@pytest.mark.parametrize("name", BOOSTED)
def test_more_candidates_than_1024(spark, wide_dir, name):
    same(spark, wide_dir, name)


def test_positions_by_ranges_of_the_order(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), (F.col("id") % 50).cast("double")).alias("embedding"), F.lit("d").alias("document"), (F.col("id") * 7919 % 3000).alias("ingest_seq")).repartition(7)
    some = lambda: [tuple(r) for r in ranking.boosted_search(rows, [1.0, 0.0], 0.9, None, settings=Settings(max_qubits=12))[0].orderBy("pos").select("pos", "ingest_seq", "enhanced_score").collect()]
    whole = some()
    monkeypatch.setattr(ranking, "ROWS_BLOCK", 100)
    assert some() == whole and [r[:2] for r in whole] == [(k, k) for k in range(3000)]


def test_halves_of_hundredths_and_of_bytes(spark, tmp_path):
    """Sizes that lie between two decimals, and prices between two whole sizes."""
    price = F.when(F.col("id") % 2 == 0, F.col("id") * 655.36).otherwise(F.col("id") + 0.125)
    spark.range(4000).select(F.col("id").alias("o_orderkey"), price.cast("double").alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    same(spark, str(tmp_path), "megabytes", ["orders"])


def held(work) -> float:
    """MB that Python and numpy hold at once for ``work``."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_routing_holds_a_bounded_part_of_the_distances():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(4000, 8)), rng.normal(size=(3000, 8))
    centres[7] = centres[2990] = x[0]  # equal cells: the lower number
    index = cells.CellIndex.of(centres, 3)
    near = index.nearest_cells(x)
    assert near[0, :2].tolist() == [7, 2990]
    gap = ((x[:50, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert near[:50].tolist() == np.argsort(gap, axis=1, kind="stable")[:, :3].tolist()
    assert held(lambda: index.nearest_cells(x)) < 64  # all distances: 92 MB
    assert held(lambda: cells._means(x, 3000, 1, 0)) < 64


def test_cell_search_takes_all_of_its_cells(spark, small_dir, monkeypatch):
    import duckdb

    monkeypatch.setattr(cells, "MAX_CELLS", 2)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small_dir}/embeddings.parquet'")
    df = catalog.QUERIES["cell_search"](spark, small_dir).select("query_id", "vec_id", "distance", "rank")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalog.ORACLES["cell_search"]).fetchall())


def test_parts_of_a_batch():
    texts = pa.array(["x" * 10, None, "", "y" * 25, "z"])
    assert [len(p) for p in batches.parts(texts, 12, 100)] == [3, 1, 1] and [len(p) for p in batches.parts(texts, 1000, 2)] == [2, 2, 1]
    assert [t for p in batches.parts(texts.slice(1), 12, 100) for t in p.to_pylist()] == texts.to_pylist()[1:] and not list(batches.parts(texts.slice(0, 0)))


def test_latent_vectors_of_many_texts_at_once():
    """As the same texts one by one, in the memory of a part of them."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 200)) for _ in range(1500)] + ["", "w1"]
    model = latent.LatentEmbedder(rng.normal(size=(8192, 64)), np.ones(8192), np.ones(64))
    found = model.embed(texts)
    assert np.allclose([model.embed([t])[0] for t in texts[-5:]], found[-5:])
    assert held(lambda: model.embed(texts[:-2])) < 150  # all at once: 290,000 values of 64 directions, twice


def test_models_get_a_part_of_a_batch(spark):
    class Counting:
        """The number of texts that the model is given at once."""

        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    rows = spark.range(0, 3000, 1, 1).select(F.lit("a text").alias("document"))
    assert embedding.embedded(rows, Counting()).agg(F.max(F.element_at("embedding", 1)), F.count("*")).first() == (batches.PART_ROWS, 3000)


def test_extractors_get_every_file_in_parts(spark):
    rows = spark.range(0, 700, 1, 1).select(F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"), F.octet_length(F.col("id").cast("string")).cast("long").alias("length"), F.when(F.col("id") != 9, F.col("id").cast("string")).cast("binary").alias("content"))
    found = {r.path: r for r in files.extracted(files.with_hash(rows), files.text_pages, lambda b: {"title": b.decode()}).collect()}
    assert len(found) == 700 and all(found[f"/{k}"].full_text == f"--- Page 1 ---\n\n{k}" and found[f"/{k}"].info == {"title": str(k)} for k in range(700) if k != 9)
    assert found["/9"].error.startswith("TypeError") and found["/9"].num_pages == 0


@pytest.mark.parametrize("mark", [" ", "\n\n"])
def test_chunks_of_a_batch_are_made_in_parts(mark):
    texts = [(f"word{mark}" * 1000)] * 3000 + [None, "", "one"]
    found: list[int] = []
    cut = lambda: found.extend(len(c) for part in chunking.cut(iter([pa.array(texts)]), 1000, 200, (mark, "")) for c in part)
    assert held(cut) < 8  # the texts of the batch: 15 MB and more
    assert found == [len(chunking.split_text(t, separators=(mark, ""))) for t in texts]


def test_texts_are_cut_once(spark):
    rows = chunking.chunks(spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, " "), (5, "word " * 300)], "id long, text string"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = [(k, at, len(c), len(cs), c) for k, t in ((1, "one"), (5, "word " * 300)) for cs in [chunking.split_text(t)] for at, c in enumerate(cs)]
    assert sorted(map(tuple, rows.collect())) == want and len(want) == 3


def test_files_of_a_batch_are_read_in_parts(spark):
    class Files:
        def mapInArrow(self, read, schema):
            return read

    read = files.extracted(Files(), files.text_pages)
    names = [f"/{k}" for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"path": names, "file_name": names, "file_size": [5000] * 3000, "file_hash": names, "content": [b"word " * 1000] * 3000})
    found: list[int] = []
    assert held(lambda: found.extend(b.num_rows for b in read([batch]))) < 8  # the files of the batch: 15 MB, more than once
    assert sum(found) == 3000
