"""Stored tables of users and chats: changes, rules, crashes and two writers."""

import pytest
from pyspark.sql import functions as F

from marlspike.plans.requests import Registration
from marlspike.plans.store import ChatStore
from marlspike.sources.keyed import Refused
from marlspike.sources.versions import Conflict


@pytest.fixture
def store(spark, tmp_path):
    s = ChatStore(spark, str(tmp_path / "store"))
    s.register(Registration("One", "one@a.example", "secret!"), 1, "salt")
    s.register(Registration("Two", "two@a.example", "secret!"), 2, "salt")
    s.create_chat(10, 1, "first", "Hello", 100)
    return s


def ids(store, name):
    return sorted(r.id for r in store.read(name).select("id").collect())


def test_changes_last_and_merge_by_key(spark, store, tmp_path):
    store.create_chat(11, 1)
    store.add_message(101, 10, 1, "Question", "Answer")
    store.add_file(7, 10, 1, "a.pdf", 5)
    store.rename_chat(10, 1, "renamed")
    store.rename_chat(11, 2, "not theirs")
    store.update_user(2, full_name="Twice", phone_number="5")
    for again in (False, True):
        s = ChatStore(spark, str(tmp_path / "store"))
        assert {r.id: r.chat_name for r in s.read("chats").collect()} == {10: "renamed", 11: None}
        assert {r.id: (r.full_name, r.email, r.phone_number) for r in s.read("users").collect()} == {1: ("One", "one@a.example", None), 2: ("Twice", "two@a.example", "5")}
        assert ids(s, "chat_history") == [100, 101] and ids(s, "uploaded_files") == [7]
        if not again:
            s.compact()
            assert s.vacuum() > 0
    s.delete_chat(10, 2)  # not theirs
    assert ids(s, "chats") == [10, 11]
    s.delete_chat(10, 1)
    assert ids(s, "chats") == [11] and ids(s, "chat_history") == [] and ids(s, "uploaded_files") == []
    s.create_chat(10, 2, "again")  # a key that went may come again
    s.clear_chats(1)
    assert ids(s, "chats") == [10]
    s.remove_user(1)
    assert ids(s, "users") == [2]


def test_rules_hold_at_commit(spark, store):
    before = store.state()["number"]
    for wrong in (
        lambda: store.register(Registration("Three", "one@a.example", "secret!"), 3, "salt"),  # the email is taken
        lambda: store.update_user(2, email="one@a.example"),
        lambda: store.create_chat(12, 99),  # no such user
        lambda: store.add_message(102, 99, 1, "q", "a"),
        lambda: store.add_file(8, 99, 1, "a.pdf", 1),
        lambda: store.remove_user(1),  # has a chat
        lambda: store.change({"users": store.read("users").unionByName(store.read("users"))}),  # keys twice
        lambda: store.change({"chats": store._none("chats").unionByName(spark.sql("select null id, 1L user_id, 'x' chat_name, now() created_at"))}),
    ):
        with pytest.raises(Refused):
            wrong()
    with pytest.raises(ValueError):
        store.update_user(77, full_name="Nobody")
    assert store.state()["number"] == before and ids(store, "users") == [1, 2] and len(store._listed("data")) == 4
    store.update_user(1, email="one@a.example")  # one's own email is no other's


def test_of_two_writers_one_fails_and_nobody_registers_twice(spark, store, tmp_path):
    other = ChatStore(spark, str(tmp_path / "store"))
    state = other.state()
    store.register(Registration("Three", "three@a.example", "secret!"), 3, "salt")
    with pytest.raises(Conflict):
        other.change({"users": other.read("users", state).where("id = 1").withColumn("email", F.lit("three@a.example"))}, state=state)
    assert {r.email for r in store.read("users").collect()} == {f"{n}@a.example" for n in ("one", "two", "three")}


def test_a_crash_leaves_all_tables_of_the_last_version(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(ChatStore, "_put", lambda *_: (_ for _ in ()).throw(OSError("the machine is gone")))
    for change in (lambda: store.delete_chat(10, 1), lambda: store.create_chat(12, 1, "x", "Hello", 103), store.compact):
        with pytest.raises(OSError):
            change()
    monkeypatch.undo()
    s = ChatStore(spark, str(tmp_path / "store"))
    assert ids(s, "chats") == [10] and ids(s, "chat_history") == [100]
    assert s.vacuum() > 0 and ids(s, "chats") == [10] and ids(s, "users") == [1, 2]


def test_segments_number_messages_within_chats(spark):
    from marlspike.operators import segments, sessions

    rows = [(k, (0 if k % 3 else k % 7) if k % 50 else None, "" if k % 4 == 0 else f"in {k}", f"out {k}" if k % 5 else " ", k // 9) for k in range(600)]
    history = spark.createDataFrame(rows, "id long, chat_id long, input_data string, output_data string, t long").withColumn("created_at", F.timestamp_seconds("t")).repartition(4)
    want = {}
    for k, chat, i, o, t in sorted(rows, key=lambda r: (r[4], r[0])):
        want.setdefault(chat, []).extend([f"user_{k}"] * bool(i.strip()) + [f"bot_{k}"] * bool(o.strip()))
    got = segments.session_segments(history, 7, range_rows=40).collect()
    assert all(len(r.messages) == 7 or r.segment == (len(want[r.chat_id]) - 1) // 7 for r in got)
    found = {}
    for r in sorted(got, key=lambda r: r.segment):
        found.setdefault(r.chat_id, []).extend(m.id for m in r.messages)
    assert found == want
    hot = max(len(r.messages) for r in got)
    assert hot <= 7 and len(want[0]) > 300  # a chat with most messages is many rows
    chats = spark.createDataFrame([(k, "" if k else "named") for k in range(9)], "id long, chat_name string").withColumn("created_at", F.timestamp_seconds(F.col("id")))
    plain = {r.id: (r.title, r.message_count, r.latest_input, r.latest_output) for r in sessions.sidebar(sessions.sessions(chats, history)).collect()}
    assert {r.id: (r.title, r.message_count, r.latest_input, r.latest_output) for r in segments.sidebar_rollup(chats, history).collect()} == plain
    assert segments.session_segments(history.limit(0)).collect() == []


def test_a_batch_that_comes_again_does_not_count_twice(spark, tmp_path):
    from marlspike.streaming.rollup import Rollup

    schema = "chat long, at long, role string, text string"
    first = spark.createDataFrame([(1, 5, "user", "second"), (1, 6, "assistant", "answer"), (2, 1, "system", "no"), (2, 2, "user", "  ")], schema)
    late = spark.createDataFrame([(1, 1, "user", "f" * 60), (1, 2, "assistant", "early"), (3, 1, "assistant", "hi")], schema)
    kept = Rollup(spark, str(tmp_path / "kept"))
    assert kept.enter(first, "a", 0) and not kept.enter(first, "a", 0) and kept.enter(late, "a", 1) and not kept.enter(late, "a", 1)
    kept.compact()
    assert not kept.enter(late, "a", 1) and kept.enter(late.where("chat = 3"), "b", 0)
    assert sorted(tuple(r) for r in Rollup(spark, str(tmp_path / "kept")).rows().collect()) == [(1, 4, "second", "answer", "f" * 50 + "..."), (3, 2, None, "hi", "New Chat")]
