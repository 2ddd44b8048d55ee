"""The Merkle manifest against plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from marlspike.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def built(hashes, fanout):
    found = [hashes]
    while len(found[-1]) > 1:
        found.append([digest("".join(found[-1][k : k + fanout])) for k in range(0, len(found[-1]), fanout)])
    return found


def expected(rows, fanout=16):
    """The seven columns of every row, from lists."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: built([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in sources}
    top = built([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            now, proof = leaf(r, r[4].translate(LOWER)) if hit else own, ""
            for levels, j in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[j - j % fanout : j - j % fanout + fanout]
                    proof += "".join(run[: j % fanout] + run[j % fanout + 1 :])
                    now = digest("".join(run[: j % fanout] + [now] + run[j % fanout + 1 :]))
                    j //= fanout
            out.append((r[0], own, trees[s][-1][0], top[-1][0], digest(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n):
    """Hot and null sources, single leaves, null ids and texts, ids that rows share, equal rows, code points beyond one byte."""
    rows = []
    for k in range(n):
        source = (None, "hot", "hot", "hot", "Z", "a", "é", "𝔘", "")[k % 9]
        rows.append((None if k % 41 == 0 else k // 2 * 2 if k % 13 == 0 else k, source, None if k % 7 == 0 else "en", k if k % 5 else None, None if k % 11 == 0 else "" if k % 17 == 0 else f"Text {k} Ünï Ⅷ" * (k % 3)))
    return rows + rows[5:9] * 3 + [(n + k, f"only {k}", "en", 1, "A") for k in range(40)]


def test_equals_plain_python_beside_clashing_columns(spark):
    rows = made(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "i", "n", "hash", "path", "_tie", "_range", "id", "a.b"):
        docs = docs.withColumn(name, F.lit("x"))
    assert rows_of(merkle.verified(docs, fanout=6, range_rows=30)) == expected(rows, 6)  # sources in several ranges, ranges of several sources


def test_one_leaf_one_source_and_runs_of_one(spark):
    for n in (1, 17):
        rows = [(k, "s", "en", 3, f"A{k}") for k in range(n)]
        assert rows_of(merkle.verified(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_and_a_changed_leaf_fails(spark):
    rows = [(1, "s", "en", 0, "Long " * 2_000_000), (2, "s", "en", 0, "b")]
    found = rows_of(merkle.verified(spark.createDataFrame(rows, SCHEMA), mod=1))
    assert [r[6] for r in found] == [False, True]  # every id is tampered with; lower case has nothing to change


def test_query_equals_plain_python_on_whole_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert rows_of(merkle.op12(spark, small_dir)) == expected(rows)
