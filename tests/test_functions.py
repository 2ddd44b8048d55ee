import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.functions import amplify, filters, text, vectors
from marlspike.operators.chunking import split_text
from marlspike.plans.requests import ChatRequest, QueryRequest, Registration, signup_errors

# amplification


@pytest.mark.parametrize(
    "count, marked, qubits, iterations, on_marked",
    [(1, 1, 1, 1, 0.5), (4, 1, 2, 1, 1.0), (4, 2, 2, 1, 0.25), (4, 3, 2, 1, 0.0), (5, 1, 3, 1, 0.7812), (1000, 1, 10, 10, None), (1024, 1024, 10, 1, None)],
)
def test_worked_values(count, marked, qubits, iterations, on_marked):
    a = amplify.Amplification.of(count, marked)
    assert (a.qubits, a.iterations) == (qubits, iterations)
    if on_marked is not None:
        assert math.isclose(a.on_marked, on_marked, abs_tol=1e-4)


def reverse(i, n):
    return int(format(i, f"0{n}b")[::-1], 2)


@pytest.mark.parametrize("seed", range(20))
def test_closed_form_equals_a_state_vector(seed):
    rng = random.Random(seed)
    count = rng.randint(1, 200)
    marked = rng.sample(range(count), rng.randint(1, count))
    a = amplify.Amplification.of(count, len(marked))
    n = 2**a.qubits
    hit = [reverse(i, a.qubits) for i in marked]
    state = np.full(n, 1 / math.sqrt(n))
    for _ in range(a.iterations):
        state[hit] *= -1
        state = 2 * state.mean() - state
    want = state**2
    assert np.allclose([want[i] for i in hit], a.on_marked)
    others = np.delete(want, hit)
    assert np.allclose(others, a.on_others)


def test_nothing_marked_amplifies_nothing():
    a = amplify.Amplification.of(10, 0)
    assert a.on_marked == a.on_others == 0


def test_sampling_is_seeded_and_near_the_expectation():
    a = amplify.Amplification.of(8, 1)
    got = a.sampled([3], seed=4)
    assert got == a.sampled([3], seed=4) and abs(got[3] - a.on_marked) < 0.06


def test_bit_reversal(spark):
    rows = spark.range(16).select("id", amplify.target(F.col("id"), 4).alias("r"), amplify.target(F.col("id"), 4, "document").alias("d")).collect()
    assert [r.r for r in rows] == [reverse(r.id, 4) for r in rows] and [r.d for r in rows] == [r.id for r in rows]
    with pytest.raises(ValueError):
        amplify.target(F.col("id"), 4, "other")


# vectors and text


def test_cosine_corners(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([-1.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "e array<float>")
    got = [r[0] for r in rows.select(vectors.cosine_to(F.col("e"), [2.0, 0.0])).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in rows.select(vectors.cosine_to(F.col("e"), [0.0, 0.0])).collect()] == [0.0] * 6


@pytest.mark.parametrize(
    "value, low",
    [("", True), (None, True), ("   ", True), ("--- Page 1 ---", True), ("a" * 19, True), ("a" * 20, False), ("é" * 20, False), ("漢" * 20, False), ("-" * 50, True), (" --- PAGE 12 --\x1f", True)],
)
def test_low_information(spark, value, low):
    assert spark.createDataFrame([(value,)], "t string").select(text.low_information(F.col("t"))).first()[0] is low


def test_text_rules(spark):
    row = spark.createDataFrame([("x" * 50, "y" * 51, "", "kept", "   a b\x85")], "a string, b string, e string, k string, s string")
    got = row.select(
        text.session_title(F.col("a"), F.lit("New Chat")), text.session_title(F.col("b"), F.lit(None).cast("string")), text.session_title(F.col("a"), F.col("k")), text.first_filled(F.col("e"), F.col("k")), text.strip(F.col("s")),
        text.password_strength(F.lit("abc")), text.password_strength(F.lit("abcdefgh1")), text.password_strength(F.lit("Abcdefgh1!")), text.file_name(F.lit("/x/y.pdf")),
    ).first()
    assert list(got) == ["x" * 50, "y" * 50 + "...", "kept", "kept", "a b", "Weak", "Medium", "Strong", "y.pdf"]
    words = spark.createDataFrame([("yes",), (" OFF ",), ("maybe",), ("prod",), ("Debug",), ("",), (" ",)], "w string").select(text.truthy(F.col("w"))).collect()
    assert [w[0] for w in words] == [True, False, None, False, True, None, None]
    lists = spark.createDataFrame([('["http://a/", "\'b\'"]',), (" http://a/ , 'c' ,",)], "t string").select(text.origin_list(F.col("t"))).collect()
    assert [x[0] for x in lists] == [["http://a", "b"], ["http://a", "c"]]


# filters


@pytest.mark.parametrize(
    "metadata, session, user, want",
    [
        (None, None, None, None), (None, "session-1", None, {"session_id": "session-1"}), (None, None, 1, {"user_id": "1"}),
        (None, "session-1", 1, {"$and": [{"session_id": "session-1"}, {"user_id": "1"}]}),
        ({"$and": [{"topic": "report"}, {"page": "1"}]}, None, None, {"$and": [{"topic": "report"}, {"page": "1"}]}),
        ({"topic": "report", "page": 1, "none": None}, None, None, {"$and": [{"topic": "report"}, {"page": "1"}]}),
        ({"$or": [{"a": "1"}]}, "s", None, {"$and": [{"session_id": "s"}, {"$or": [{"a": "1"}]}]}),
    ],
)
def test_where_clause(metadata, session, user, want):
    assert filters.where_clause(metadata, session, user) == want


def test_compiled_filters(spark):
    rows = spark.createDataFrame([("1", {"n": "5", "t": "a"}, "s1"), ("2", {"n": "12"}, "s2"), ("3", {}, None)], "id string, metadata map<string,string>, session_id string")
    get = lambda w: [r.id for r in rows.where(filters.compiled(w, ["session_id"])).orderBy("id").collect()]
    assert get(None) == ["1", "2", "3"] and get({"session_id": "s1"}) == ["1"]
    assert get({"n": {"$gt": 6}}) == ["2"] and get({"n": {"$lte": 5}}) == ["1"] and get({"t": {"$ne": "a"}}) == ["2", "3"]
    assert get({"n": {"$in": [5, "12"]}}) == ["1", "2"] and get({"t": {"$nin": ["a"]}}) == ["2", "3"] and get({"$or": [{"t": "a"}, {"session_id": "s2"}]}) == ["1", "2"]
    with pytest.raises(ValueError):
        get({"n": {"$like": "5"}})
    same = lambda w: [r.id for r in rows.where(filters.same_metadata(w)).orderBy("id").collect()]
    assert same({"t": "A"}) == ["1"] and same({"t": ""}) == ["2", "3"] and same({}) == ["1", "2", "3"]
    plan = rows.where(filters.compiled({"session_id": "s1"}, ["session_id"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "session_id" in plan


# splitter


@pytest.mark.parametrize("length, want", [(999, 1), (1000, 1), (1001, 2), (3000, 4)])
def test_splitting_one_word(length, want):
    got = split_text("x" * length)
    assert len(got) == want and max(map(len, got)) <= 1000


def test_splitting_keeps_all_text_in_order():
    rng = random.Random(6)
    for _ in range(30):
        body = "".join(rng.choice(["word ", "longerword ", "\n", "\n\n", "x" * rng.randint(1, 1500)]) for _ in range(rng.randint(0, 400)))
        got = split_text(body)
        assert all(0 < len(c) <= 1000 and c == c.strip() for c in got)
        at = 0
        for c in got:  # every chunk is a part of the text, and they advance
            k = body.find(c, max(0, at - 1000 - len(c)))
            assert k >= 0
            at = max(at, k + len(c))
        assert {w for w in body.split() if len(w) < 700} <= {w for c in got for w in c.split()} or not got


def test_splitting_prefers_paragraphs():
    one, two = "a b " * 150, "c d " * 150
    assert split_text(f"{one}\n\n{two}") == [one.strip(), two.strip()]
    assert split_text(None) == split_text("") == split_text("  \n ") == []


# requests


def test_request_bounds():
    assert QueryRequest("q").top_k == 5
    for bad in ({"query": ""}, {"query": " "}, {"query": "x" * 1001}, {"query": "q", "top_k": 21}, {"query": "q", "threshold": 1.5}):
        with pytest.raises(ValueError):
            QueryRequest(**bad)
    assert ChatRequest("m").scope is None and ChatRequest("m", chat_id=7).scope == "7" and ChatRequest("m", session_id="s", chat_id=7).scope == "s"
    with pytest.raises(ValueError):
        ChatRequest("m", max_context_results=11)
    Registration("A", "a@b.co", "secret")
    for bad in (("", "a@b.co", "secret"), ("A", "a@b", "secret"), ("A", "a@b.co", "short")):
        with pytest.raises(ValueError):
            Registration(*bad)
    assert set(signup_errors(" ", "x", "short", "other")) == {"full_name", "email", "password", "again"} and signup_errors("A", "a@b.co", "longenough", "longenough") == {}
