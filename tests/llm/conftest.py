import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size string, score string, batch string, part string, row string, `odd name` string, `dotted.name` string, _nth string, `tick``ed` string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of the long text" for i in range(20_000))
    return [(1, None), (2, ""), (3, "short"), (4, long), (5, long), (6, "The same text, twice over."), (6, "The same text, twice over."), (7, "The same text, twice over."), (None, "no id here but a text of its own"), (8, " \t\n "), (9, "é" * 150), (10, "é" * 150)]
