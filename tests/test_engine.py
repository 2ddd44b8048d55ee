import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.operators import accounts, cells, context, embedding, ranking, sessions
from marlspike.plans import ingest, requests, retrieve
from marlspike.plans.requests import ChatRequest, Registration
from marlspike.settings import Settings
from marlspike.sources import collection, files, pdf, tables
from marlspike.sources.collection import Collection, Conflict, stamped, usable_path
from marlspike.streaming.ingest import ingest_new


def one_hot(spark, count, session="session-1", user="1"):
    rows = [(str(i), [1.0 if j == i else 0.0 for j in range(count)], f"doc-{i}", {"filename": f"doc-{i}.pdf", "session_id": session, "user_id": user}, session, user, i) for i in range(count)]
    return spark.createDataFrame(rows, "id string, embedding array<float>, document string, metadata map<string,string>, session_id string, user_id string, ingest_seq long")


def axis(i, n):
    return [1.0 if j == i else 0.0 for j in range(n)]


def test_boosted_top_one(spark):
    found, method, reason, _ = ranking.boosted_search(one_hot(spark, 4), axis(0, 4), 0.1, 1)
    row = found.first()
    assert (row.id, method, reason) == ("0", "quantum_enhanced", None) and row.enhanced_score == pytest.approx(3.0) and row.similarity_score == row.enhanced_score and row.classical_similarity == 1.0


def test_boost_lands_on_the_reversed_index(spark):
    found, *_ = ranking.boosted_search(one_hot(spark, 4), axis(1, 4), 0.1, None)
    p = {r.id: r.quantum_probability for r in found.collect()}
    assert p["2"] == pytest.approx(1.0) and p["1"] == pytest.approx(0.0)
    found, *_ = ranking.boosted_search(one_hot(spark, 4), axis(1, 4), 0.1, None, bit_order="document")
    assert {r.id: r.quantum_probability for r in found.collect()}["1"] == pytest.approx(1.0)


def test_fallbacks(spark):
    found, method, reason, _ = ranking.boosted_search(one_hot(spark, 3), axis(0, 3), 0.1, 1, settings=Settings(max_qubits=1))
    assert (found.first().id, method, reason) == ("0", "classical_fallback", "too_many_documents")
    _, method, reason, _ = ranking.boosted_search(one_hot(spark, 4), [0.0] * 4, 0.1, 1)
    assert (method, reason) == ("classical_fallback", "no_marked_items")
    _, method, reason, _ = ranking.boosted_search(one_hot(spark, 4).limit(0), axis(0, 4), 0.1, 1)
    assert (method, reason) == ("none", "no_candidates")


@pytest.mark.parametrize("count, method", [(1024, "quantum_enhanced"), (1025, "classical_fallback")])
def test_size_limit(spark, count, method):
    rows = spark.range(count).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.lit("d").alias("document"), F.col("id").alias("ingest_seq"))
    assert ranking.boosted_search(rows, [1.0, 0.0], 0.9, 3)[1] == method


def test_top_k_plan_is_one_scan_and_a_bounded_sort(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.lit("text").alias("document"), F.col("vec_id").alias("ingest_seq"))
    plan = ranking.classical(rows, [0.1] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_one_wrong_length(spark):
    rows = one_hot(spark, 3).union(spark.createDataFrame([("9", [1.0], "d", {}, "s", "u", 9)], one_hot(spark, 3).schema))
    assert {r.similarity_score for r in ranking.scored(rows, axis(0, 3), strict=False).collect()} == {0.0}
    assert {r.id: r.similarity_score for r in ranking.scored(rows, axis(0, 3)).collect()}["0"] == 1.0


def test_informative_first_equals_explicit_partition(spark):
    rows = [(str(i), float(s), low, i) for i, (s, low) in enumerate([(0.9, True), (0.5, False), (0.5, False), (0.8, True), (0.1, False)])]
    df = spark.createDataFrame(rows, "id string, similarity_score double, low_information boolean, ingest_seq long")
    ranked = sorted(rows, key=lambda r: (-r[1], r[3]))
    for k in range(1, 7):
        want = ([r[0] for r in ranked if not r[2]] + [r[0] for r in ranked if r[2]])[:k]
        assert [r.id for r in ranking.informative_first(df, k, ["ingest_seq"]).collect()] == want


def test_nearest_and_similar(spark):
    rows = one_hot(spark, 4)
    got = ranking.nearest(rows, axis(2, 4), 2).collect()
    assert got[0].id == "2" and got[0].similarity_score == 1.0 and got[1].distance == 2.0
    assert [r.id for r in ranking.similar(rows, "1", 2).collect()] == ["0", "2"] and ranking.similar(rows, "x", 2).collect() == []
    model, indexed = ranking.random_projection_index(rows)
    from pyspark.ml.linalg import Vectors

    assert model.approxNearestNeighbors(indexed, Vectors.dense(axis(3, 4)), 1).first().id == "3"


def test_batch_is_bounded(spark):
    queries = spark.createDataFrame([(i, axis(i, 3)) for i in range(3)], "q long, query array<double>")
    got = {(r.q, r.id) for r in ranking.batch_top_k(queries, one_hot(spark, 3), 1, "q", ["ingest_seq"]).collect()}
    assert got == {(0, "0"), (1, "1"), (2, "2")}
    with pytest.raises(ValueError):
        ranking.batch_top_k(queries, one_hot(spark, 3), 1, "q", ["ingest_seq"], max_queries=2)


def test_any_number_of_batch_queries_goes_in_blocks(spark):
    queries = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(1200)], "q long, query array<double>")
    got = {(r.q, r.id) for r in ranking.batch_top_k(queries, one_hot(spark, 3), 1, "q", ["ingest_seq"]).collect()}
    assert got == {(i, str(i % 3)) for i in range(1200)}
    small = ranking.batch_top_k(queries.where("q < 10"), one_hot(spark, 3), 2, "q", ["ingest_seq"], block=3)
    assert sorted((r.q, r.rank) for r in small.collect()) == [(i, k) for i in range(10) for k in (1, 2)]


@pytest.mark.parametrize("boosted", [True, False])
def test_a_vector_of_another_length_gives_all_zeros_through_retrieve(spark, boosted):
    rows = spark.createDataFrame([(0, "0", "doc", [1.0, 0.0], {}), (1, "1", "doc", [1.0], {})], "ingest_seq long, id string, document string, embedding array<double>, metadata map<string,string>")
    e = retrieve.retrieve(rows, [1.0, 0.0], boosted=boosted)
    assert [(r.id, r.similarity_score) for r in e.results.collect()] == [("0", 0.0), ("1", 0.0)]
    assert (e.search_method, e.fallback_reason) == (("classical_fallback", "no_marked_items") if boosted else ("classical", None))
    assert {r.similarity_score for r in retrieve.retrieve(rows, [1.0, 0.0], boosted=boosted, strict=True).results.collect()} != {0.0}


def test_two_streams_into_one_collection_keep_their_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("Words of a file that two sessions have")
    c, model = Collection(spark, str(tmp_path / "c")), embedding.HashEmbedder(16)
    for _ in range(2):  # the second run of each stream finds nothing new
        for session in ("s1", "s2"):
            ingest_new(spark, str(tmp_path), "*.pdf", c, model, str(tmp_path / f"at-{session}"), files.text_pages, session).awaitTermination()
    rows = c.open().collect()
    assert sorted(r.session_id for r in rows) == ["s1", "s2"]
    assert all(dt.datetime.fromisoformat(r.metadata["processed_at"]) for r in rows)


def test_request_columns_agree_with_requests(spark):
    def made(f, *values):
        try:
            f(*values)
        except (ValueError, TypeError):
            return False
        return True

    texts = ["", " ", "\u2003", "a", "x" * 100, "x" * 101, "x" * 1000, "x" * 1001, "é" * 2000, "y" * 2001]
    mails = ["", "a@b.c", "a@b", "a b@c.d", "a@b.c\n", " a@b.c", "é@ü.ö", "a@@b.c", "a@b.c.d"]
    rows = [(t, m, k, x) for t in texts for m in mails[: 3 if len(t) > 1 else None] for k, x in ((0, 0.0), (1, 1.0), (10, 0.5), (11, 1.1), (20, -0.1), (21, 0.5))]
    t, m, k, x = (F.col(c) for c in "tmkx")
    found = spark.createDataFrame(rows, "t string, m string, k int, x double").select(
        "t", "m", "k", "x", requests.query_in_bounds(t, k, x).alias("query"), requests.chat_in_bounds(t, k, x).alias("chat"), requests.similar_in_bounds(k).alias("similar"), requests.registration_in_bounds(t, m, t, F.repeat(F.lit("5"), k)).alias("registration"),
        F.struct(*[v.alias(n) for n, v in requests.signup_messages(t, m, t, F.left(t, F.lit(50))).items()]).alias("signup"), requests.scope(t, k).alias("scope"),
    )
    for r in found.collect():
        assert r.query == made(requests.QueryRequest, r.t, r.k, r.x) and r.similar == made(requests.SimilarRequest, "d", r.k)
        assert r.chat == made(lambda: ChatRequest(r.t, max_context_results=r.k, temperature=r.x))
        assert r.registration == made(Registration, r.t, r.m, r.t, "5" * r.k), r
        assert {n: v for n, v in r.signup.asDict().items() if v} == requests.signup_errors(r.t, r.m, r.t, r.t[:50]), r
        assert r.scope == ChatRequest("m", r.t, r.k).scope
    missing = spark.createDataFrame([(None, None, None, None)], "t string, m string, k int, x double").select(requests.query_in_bounds(t, k, x), requests.chat_in_bounds(t, k, x), requests.similar_in_bounds(k), requests.registration_in_bounds(t, m, t, t)).first()
    assert set(missing) == {False}


def test_retrieve_scopes_and_errors(spark):
    rows = one_hot(spark, 4).union(one_hot(spark, 4, "session-2", "2").withColumn("id", F.concat(F.lit("b"), "id")))
    e = retrieve.retrieve(rows, axis(0, 4), 1, 0.1, session_id="session-1", user_id=1)
    assert (e.candidate_count, e.search_method, e.results.first().id) == (4, "quantum_enhanced", "0") and e.retrieval_time_ms > 0
    assert retrieve.retrieve(rows, axis(0, 4), session_id="none").fallback_reason == "no_candidates"
    assert retrieve.retrieve(rows.drop("embedding"), axis(0, 4)).fallback_reason == "retrieval_error"
    with pytest.raises(Exception):
        retrieve.retrieve(rows.drop("embedding"), axis(0, 4), strict=True)
    assert retrieve.retrieve(rows, axis(0, 4), boosted=False, metadata={"FILENAME".lower(): "DOC-3.PDF"}).candidate_count == 2


def test_chat(spark):
    rows = one_hot(spark, 4)
    seen = []
    answer = retrieve.chat(rows, ChatRequest("hello", session_id="session-1", user_id=1, max_context_results=1), lambda _: axis(0, 4), lambda p: seen.append(p) or "yes")
    assert answer["response"] == "yes" and answer["candidate_count"] == 4 and answer["context_used"] and "Source: doc-0.pdf\ndoc-0" in seen[0]
    answer = retrieve.chat(rows, ChatRequest("hello"), lambda _: axis(0, 4), lambda p: 1 / 0)
    assert answer["fallback_reason"] == "missing_session_scope" and answer["response"] == context.FALLBACK_ANSWER


# collection and ingest


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    assert c.open().count() == 0 and not c.stats().first().has_data
    new = spark.createDataFrame([("a", "one", [1.0], {"filename": "x.pdf", "gone": None}), ("a", "one", [1.0], {"filename": "x.pdf"}), ("b", "two", [0.5], {"title": "T", "session_id": "7"})], "id string, document string, embedding array<float>, metadata map<string,string>")
    assert c.add(new, "2024-01-01T00:00:00")["added_count"] == 2
    assert c.add(new)["added_count"] == 0 and c.open().count() == 2
    rows = {r.id: r for r in c.open().collect()}
    assert rows["a"].metadata == {"filename": "x.pdf", "source_file_name": "x.pdf", "original_file_name": "x.pdf", "file_name": "x.pdf", "source": "x.pdf", "added_at": "2024-01-01T00:00:00"}
    assert rows["b"].metadata["source"] == "T" and rows["b"].session_id == "7" and rows["b"].user_id is None
    assert [r.id for r in c.scan({"session_id": "7"}).collect()] == ["b"] and "embedding" not in c.scan(embeddings=False, limit=1).columns
    assert "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,7)]" in c.scan({"session_id": "7"})._jdf.queryExecution().executedPlan().toString()
    assert c.delete(["a", "zz"])["deleted_count"] == 2 and [r.id for r in c.open().collect()] == ["b"]
    assert c.add(new.drop("embedding"))["success"] is False
    c.reset()
    assert c.open().count() == 0


VECTORS = "id string, document string, embedding array<float>, metadata map<string,string>"


def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch):
    c = Collection(spark, str(tmp_path / "c"))
    assert c.open().count() == 0 and not (tmp_path / "c").exists()  # opening writes nothing
    c.add(spark.createDataFrame([("a", "one", [1.0], {})], VECTORS))
    write = Collection._write

    def broken(self, rows):
        write(self, rows)
        raise OSError("the machine is gone")

    monkeypatch.setattr(Collection, "_write", broken)
    with pytest.raises(OSError):
        c.add(spark.createDataFrame([("b", "two", [1.0], {})], VECTORS))
    monkeypatch.undo()
    monkeypatch.setattr(Collection, "_put", lambda *_: (_ for _ in ()).throw(OSError("the machine is gone")))
    for change in (lambda: c.delete(["a"]), c.reset):  # a delete has written its bitmaps by then
        with pytest.raises(OSError):
            change()
    monkeypatch.undo()
    (tmp_path / "c/versions/.half").write_text("{")  # a version that never got its name
    assert [r.id for r in Collection(spark, str(tmp_path / "c")).open().collect()] == ["a"]
    assert c.vacuum() == 3 and [r.id for r in c.open().collect()] == ["a"]  # a folder, its manifest, bitmaps


def test_a_delete_writes_only_bitmaps(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    row = lambda k: (f"r{k}", f"text {k}", [1.0], {"session_id": f"s{k % 5}"})
    c.add(spark.createDataFrame([row(k) for k in range(3000)], VECTORS).repartition(3))
    c.add(spark.createDataFrame([row(k) for k in range(3000, 3100)], VECTORS))
    files = sorted(str(p) for p in (tmp_path / "c/data").rglob("*.parquet"))
    live = set(range(3100))
    for gone in (range(0, 3100, 7), range(0, 40), [5]):
        ids = spark.createDataFrame([(f"r{k}",) for k in gone] + [("absent",), (f"r{gone[0]}",)], "id string")
        assert c.delete(ids)["deleted_count"] == len(gone) + 2
        live -= set(gone)
        assert {int(r.id[1:]) for r in c.open().collect()} == live and c._version()["rows"] == len(live)
        assert {int(r.id[1:]) for r in c.scan({"session_id": "s3"}).collect()} == {k for k in live if k % 5 == 3}
    assert sorted(str(p) for p in (tmp_path / "c/data").rglob("*.parquet")) == files and len(list((tmp_path / "c/deletes").iterdir())) == 3
    assert c.add(spark.createDataFrame([row(7), row(8), row(3099)], VECTORS))["added_count"] == 2  # deleted ones may come again
    live |= {7, 8}
    assert {int(r.id[1:]) for r in Collection(spark, str(tmp_path / "c")).open().collect()} == live
    c.compact()
    assert c._version()["deletes"] is None and c._version()["rows"] == len(live) == c.open().count()
    c.vacuum()
    assert not list((tmp_path / "c/deletes").iterdir()) and {int(r.id[1:]) for r in c.open().collect()} == live
    now = c._version()
    c.delete(["r1", "r50"])
    with pytest.raises(Conflict):
        c._commit(now["number"], [], 0, 0)


def test_a_scoped_scan_opens_only_files_that_may_match(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collection, "LISTED", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c = Collection(spark, str(tmp_path / "c"))
        for base in (0, 400):
            c.add(spark.createDataFrame([(f"r{k}", "t", [1.0], {"session_id": f"s{k % 40:02d}", "user_id": f"{k % 3}"} if k % 10 else {}) for k in range(base, base + 400)], VECTORS))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = len(c.open().inputFiles())
    assert every >= 6
    for where in ({"session_id": "s07"}, {"$and": [{"session_id": "s07"}, {"user_id": "1"}]}, {"session_id": {"$eq": "s07"}}):
        found = c.scan(where)
        assert 1 <= len(found.inputFiles()) <= every // 2
        assert {r.id for r in found.collect()} == {f"r{k}" for k in range(800) if k % 40 == 7 and ("$and" not in where or k % 3 == 1)}
    assert c.scan({"session_id": "s99"}).collect() == [] and c.scan({"$and": [{"session_id": "s07"}, {"user_id": "9"}]}).collect() == []
    either = c.scan({"$or": [{"session_id": "s07"}, {"session_id": "s01"}]})
    assert len(either.inputFiles()) == every and either.count() == 40


def test_of_two_writers_one_fails(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.create()
    now = c._version()
    c.add(spark.createDataFrame([("a", "one", [1.0], {})], VECTORS))
    with pytest.raises(Conflict):
        c._commit(now["number"], [], 0, 0)
    assert [r.id for r in c.open().collect()] == ["a"]


def test_a_stream_batch_that_comes_again_enters_nothing(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("Words of a file that comes twice")
    found = files.read_files(spark, str(tmp_path))
    c, model = Collection(spark, str(tmp_path / "c")), embedding.HashEmbedder(16)
    counts = [ingest.ingest(found, c, model, files.text_pages, processed_at="batch 0")["added_count"] for _ in range(2)]
    assert counts == [1, 0]


def test_pdf_files(spark):
    texts = ["Hello (w) é 漢 😀\nline two\n\nfour", "", "  x\\y )( "]
    data = pdf.write(texts, {"title": "T é", "author": "A"})
    assert pdf.page_texts(data) == texts and pdf.info(data) == {"title": "T é", "author": "A", "subject": "", "creator": ""}
    plain = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> >> >> >> endobj
3 0 obj << /Type /Page /Contents [4 0 R] >> endobj
4 0 obj << /Length 5 0 R >> stream
BT /F1 12 Tf 72 700 Td (Hello \\(World\\) \\351) Tj 0 -14 Td [(Ne) -50 (xt) -300 <6C696E65>] TJ ET
endstream endobj
5 0 obj 93 endobj
6 0 obj << /Type /Page /Contents 7 0 R >> endobj
7 0 obj << /Length 3 /Filter /FlateDecode >> stream
bad
endstream endobj
trailer << /Root 1 0 R >>
"""
    assert pdf.page_texts(plain) == ["Hello (World) é\nNext line", None] and pdf.info(plain) == {}
    rows = spark.createDataFrame([("/a.pdf", len(plain), plain), ("/b.pdf", 3, b"no!"), ("/c.pdf", 9, plain.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))], "path string, length long, content binary")
    got = {r.file_name: r for r in files.extracted(files.with_hash(rows), files.pdf_pages, files.pdf_info).collect()}
    assert got["a.pdf"].num_pages == 2 and len(got["a.pdf"].page_texts) == 1 and got["a.pdf"].error is None
    assert "not a PDF" in got["b.pdf"].error and "encrypted" in got["c.pdf"].error


def test_cells_find_nine_tenths_of_the_nearest(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)) + np.repeat(rng.normal(size=(10, 24)) * 2, 300, axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 24)], "vec_id long, embedding array<double>").repartition(5)
    queries = rows.where("vec_id < 60 or vec_id >= 9000").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    exact = {(r.q, r.vec_id) for r in ranking.batch_nearest(queries, rows, 5, "q", ["vec_id"], block=25).collect()}
    gap = ((x[:60, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    near = {(q, int(i)) for q in range(60) for i in np.argsort(gap[q], kind="stable")[:5]}
    assert {(q, i) for q, i in exact if q < 60} == near
    monkeypatch.setattr(cells, "ROWS_BLOCK", 40)  # cells in several blocks
    index = cells.CellIndex.fit(rows, cells=30, top_k=5).write(rows, str(tmp_path / "index"))
    assert index.rows[cells.NOWHERE] == 3 and sum(index.rows.values()) == 3003
    assert index.probes < 15 and index.rerank < 300  # half of the cells, a tenth of the rows
    again = cells.CellIndex.open(spark, str(tmp_path / "index"))
    found = again.search(queries, 5, "q", ["vec_id"], 6).collect()
    assert len({(r.q, r.vec_id) for r in found} & near) >= 0.9 * len(near) and {r.q for r in found} == set(range(60))
    assert all(r.rank == 1 and r.distance == 0.0 for r in found if r.q == r.vec_id)
    pairs = again.shortlisted(again.routed(queries, "q"), 63, "q", block=25).groupBy("q").count().collect()
    assert {r["count"] for r in pairs} == {again.rerank}  # exact distances made for each query, of 3,000
    one = again.nearest(spark, x[7].tolist(), 5, ["vec_id"])
    assert len({r.vec_id for r in one.collect()} & {i for q, i in near if q == 7}) >= 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    assert again.nearest(spark, [1.0], 5, ["vec_id"]).collect() == []


def test_index_of_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = cells.CellIndex.fit(rows).write(rows, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, [1.0])], "q long, query array<double>")
    assert index.search(queries, 5, "q", ["vec_id"]).collect() == [] and cells.CellIndex.open(spark, str(tmp_path / "index")).nearest(spark, [1.0], 3, ["vec_id"]).collect() == []


def test_batches_of_many_ties_and_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)], "low" if i % 2 else "a text with letters enough to count") for i in range(5000)] + [(7000, None, None), (7001, [1.0], "x")], "vec_id long, embedding array<double>, document string").repartition(3)
    queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "q long, query array<double>")
    got = [(r.q, r.rank, r.vec_id) for r in ranking.batch_top_k(queries, rows, 4, "q", ["vec_id"], 6).collect()]
    assert sorted(got) == [(q, k + 1, v) for q in range(3) for k, v in enumerate([i for i in range(60) if i % 3 == q and i % 2 == 0][:4])]
    assert ranking.batch_top_k(queries.limit(0), rows, 4, "q", ["vec_id"]).collect() == []
    assert ranking.batch_top_k(queries, rows.limit(0), 4, "q", ["vec_id"]).collect() == []


def test_stamp_of_empty_metadata(spark):
    rows = spark.createDataFrame([("a", None), ("b", {"file_name": ""})], "id string, metadata map<string,string>")
    assert [r.metadata["source"] for r in stamped(rows, "t").orderBy("id").collect()] == ["Unknown", "Unknown"]


def test_ingest_and_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("First page of a file with words enough to be told apart\f  \fThird page")
    (folder / "b.txt").write_text("   ")
    c, model = Collection(spark, str(tmp_path / "c")), embedding.HashEmbedder(16)
    run = lambda: ingest_new(spark, str(folder), "*.txt", c, model, str(tmp_path / "cp"), files.text_pages, "s9", 3).awaitTermination()
    run()
    assert c.open().count() == 0  # only .pdf names pass
    found = files.read_files(spark, str(folder), "*.txt").withColumn("file_name", F.regexp_replace("file_name", "txt$", "PDF"))
    assert {r.error for r in files.extracted(found, files.text_pages).collect()} == {None, "No text content found in PDF"}
    got = ingest.ingest(found, c, model, files.text_pages, "s9", 3)
    assert got["added_count"] == 1 and got["refused"] == 0
    row = c.open().first()
    assert row.session_id == "s9" and row.user_id == "3" and row.metadata["num_pages"] == "3" and "--- Page 3 ---" in row.document and row.metadata["chunk_id"] == "0"
    done = ingest.counters(c.open()).first()
    assert (done.chunks_created, done.embeddings_stored, done.files, done.pages_processed) == (1, 1, 1, 3)
    (folder / "c.pdf").write_text("A file that arrives later, with words of its own")
    query = lambda: ingest_new(spark, str(folder), "*.pdf", c, model, str(tmp_path / "cp2"), files.text_pages).awaitTermination()
    query()
    query()
    assert c.open().count() == 2


def test_upload_rules(spark):
    rows = spark.createDataFrame([("a.PDF", 5), ("", 5), (None, 5), ("a.txt", 5), ("a.pdf", 99), ("a.pdf", 0), ("x" * 300 + ".pdf", 1)], "n string, s long")
    got = [r[0] for r in rows.select(files.upload_error(F.col("n"), F.col("s"), 50, 255)).collect()]
    assert [g and g[:9] for g in got] == [None, "File must", "File must", "File must", "File size", None, "Filename "]


# sessions


T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def chats(spark):
    chats = spark.createDataFrame([(1, 7, "named", T0), (2, 7, None, T0 + dt.timedelta(1)), (3, 8, "", T0)], tables.CHATS)
    row = lambda i, c, a, b: (i, c, 7, a, b, T0 + dt.timedelta(minutes=i), T0, True, None)
    history = spark.createDataFrame([row(12, 1, "second?", "again"), row(11, 1, "first?", "answer"), row(13, 1, " ", ""), row(14, 3, "", "bot only")], tables.CHAT_HISTORY)
    return chats, history


def test_sessions_and_sidebar(chats):
    got = {r.id: r for r in sessions.sessions(*chats).collect()}
    assert [m.id for m in got["1"].messages] == ["user_11", "bot_11", "user_12", "bot_12"]
    assert got["2"].title == "New Chat" and got["2"].messages[0].content == sessions.WELCOME and got["3"].title == "New Chat" and [m.id for m in got["3"].messages] == ["bot_14"]
    bar = sessions.sidebar(sessions.sessions(*chats), "1").collect()
    assert bar[0].id == "2" and {r.id: (r.message_count, r.latest_input, r.latest_output, r.is_active) for r in bar}["1"] == (4, "second?", "again", True)
    assert bar[0].latest_input is None


def test_changes(spark, chats):
    c, h = chats
    at = F.lit(T0)
    c2, h2 = sessions.chat_created(c, h, 9, 7, None, "hi", 90, at)
    assert c2.count() == 4 and h2.where("id = 90").first().output_data == "hi"
    assert sessions.message_added(h, 91, 1, 7, "q", None, at).where("id = 91").first().output_data == ""
    c3, h3 = sessions.chat_deleted(c, h, 1, 7)
    assert c3.count() == 2 and h3.count() == 1 and sessions.chat_deleted(c, h, 1, 8)[0].count() == 3
    assert sessions.chats_cleared(c, h, 7)[0].count() == 1
    assert sessions.chat_renamed(c, 1, 7, "x").where("id = 1").first().chat_name == "x" and sessions.chat_renamed(c, 1, 8, "x").where("id = 1").first().chat_name == "named"
    users = spark.createDataFrame([(1, "A", "a@b.co", None, "h", T0)], tables.USERS)
    assert sessions.row_updated(users, 1, {"full_name": "B", "email": None}).first().full_name == "B"
    with pytest.raises(ValueError):
        sessions.row_updated(users, 1, {"full_name": None})
    assert sessions.row_deleted(users, 1).count() == 0 and "password" not in sessions.public_users(users).columns and sessions.row_by_id(users, 1).count() == 1
    assert sessions.of_user(c, h, 8).count() == 1
    up = sessions.file_added(spark.createDataFrame([], tables.UPLOADED_FILES), 1, 1, 7, "a.pdf", 10, at=at)
    assert sessions.files_of_chat(up, 1).first().fileName == "a.pdf"
    results = spark.createDataFrame([("a.pdf", 2, "later"), ("a.pdf", 1, "first")], "file_name string, seq int, result string")
    assert sessions.files_with_results(up, results).first().result == "first"


def test_accounts(spark, tmp_path):
    users = spark.createDataFrame([], tables.USERS)
    users = accounts.registered(users, Registration("Ann", "ann@b.co", "secret1"), 1, "salt", F.lit(T0)).cache()
    assert users.first().password.startswith("salt:") and accounts.logged_in(users, "ann@b.co", "secret1").first().full_name == "Ann"
    assert accounts.logged_in(users, "ann@b.co", "wrong").count() == 0 and accounts.logged_in(users, "x@b.co", "secret1").count() == 0
    assert "password" not in accounts.profile(users, 1).columns
    with pytest.raises(ValueError):
        accounts.registered(users, Registration("Bob", "ann@b.co", "secret1"), 2)
    assert accounts.profile_updated(users, 1, phone_number="5").first().phone_number == "5"
    for bad in ((1, {}), (2, {"full_name": "x"})):
        with pytest.raises(ValueError):
            accounts.profile_updated(users, bad[0], **bad[1])
    assert accounts.removed(users, 1).count() == 0
    assert usable_path(str(tmp_path / "a"), str(tmp_path / "b")) == str(tmp_path / "a")
