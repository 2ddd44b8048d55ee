"""The registry of queries and their SQL, and the inputs that queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..settings import DEFAULTS

QUERY_ID = 7
DIGITS = 6
ORDER = ("vec_id",)
#: The SQL of the boosted queries boosts any number of candidates.
UNBOUNDED = replace(DEFAULTS, max_qubits=62)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: vectors with metadata and what is stored of their text: whether it is low in information."""
    docs = table(spark, d, "documents").select("doc_id", text.low_information(F.col("text")).alias("low_information"), "lang", "source")
    rows = table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    metadata = F.map_filter(F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda _, v: v.isNotNull())
    return rows.select("vec_id", F.col("vec_id").cast("string").alias("id"), "embedding", F.coalesce("low_information", F.lit(True)).alias("low_information"), metadata.alias("metadata"), F.col("source").alias("session_id"), F.col("label").cast("string").alias("user_id"), "label")


def vectors_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("id"), "embedding", F.lit(None).cast("string").alias("document"), "label")


def query_vector(spark: SparkSession, d: str, vec_id: int = QUERY_ID) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# SQL parts of the oracles

_WHITE = r"[\s\x0b\p{Z}\x1c-\x1f\x85]"
_STRIP = rf"regexp_replace(%s, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
_LOW = rf"coalesce({_STRIP % 'document'} = '' or regexp_matches({_STRIP % 'document'}, '(?i)^-+\s*page\s*\d+\s*-+$') or length(regexp_replace({_STRIP % 'document'}, '[^\p{{L}}\p{{N}}]', '', 'g')) < 20, true)"
_COSINE = "greatest(coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0), 0)"
_BASE = f"""
with q as (select embedding::double[] as qv from embeddings where vec_id = {QUERY_ID}),
c as (
  select e.vec_id, e.label, d.text as document, d.lang, d.source, e.embedding::double[] as v
  from embeddings e left join documents d on e.vec_id = d.doc_id),
s as (select c.*, round({_COSINE.format(a='v', b='qv')}, 6) as score, {_LOW} as low from c, q where true {{where}})
"""
_BOOST = """
, n as (
  select count(*) as cnt, count(*) filter (where score >= {t}) as m, greatest(ceil(log2(greatest(count(*), 2))), 1)::int as nq from s),
g as (
  select *, pow(2, nq) as states, greatest(1, least(10, floor(pi() / 4 * sqrt(cnt / nullif(m, 0)))))::int as k,
    asin(sqrt(m / pow(2, nq))) as theta from n),
w as (
  select *, pow(sin((2 * k + 1) * theta), 2) / nullif(m, 0) as pm, coalesce(pow(cos((2 * k + 1) * theta), 2) / nullif(states - m, 0), 0) as po from g),
p as (select s.*, score >= {t} as marked, row_number() over (order by vec_id) - 1 as pos from s),
r as (
  select list_sum(list_transform(range(0, nq), lambda j: ((pos >> j) & 1) << (nq - 1 - j)))::bigint as hit from p, w where marked),
b as (
  select p.*, case when r.hit is not null then pm else po end as prob from p cross join w left join r on p.pos = r.hit),
e as (select *, round(score * (1 + prob * 2.0), 6) as enhanced from b)
"""


def base(where: str = "") -> str:
    return _BASE.replace("{where}", where)


def with_text(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    """Ranked rows with their texts: the few rows go to the documents, not the texts to the ranking."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("document"))
    return docs.join(F.broadcast(ranked), "vec_id", "right")


def chat_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Chats and history rows made of conversations: each turn is one history row."""
    talk = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.col("turn") * 60)
    chats = talk.groupBy(F.col("conv_id").alias("id")).agg((F.col("id") % 10).alias("user_id"), F.timestamp_seconds(F.col("id") * 3600).alias("created_at")).select("id", "user_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("chat "), F.col("id").cast("string"))).alias("chat_name"), "created_at")
    side = lambda who: F.when(F.col("role") == who, F.col("text")).otherwise("")
    history = talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), (F.col("conv_id") % 10).alias("user_id"), side("user").alias("input_data"), side("assistant").alias("output_data"), at.alias("created_at"))
    return chats, history


_MESSAGES = rf"""
with h as (select conv_id * 1000 + turn as id, conv_id as chat_id, case when role = 'user' then text else '' end as i, case when role = 'assistant' then text else '' end as o, turn from conversations),
m as (select chat_id, turn, id, 0 as side, 'user_' || id as mid, i as content from h where {_STRIP % 'i'} <> '' union all select chat_id, turn, id, 1, 'bot_' || id, o from h where {_STRIP % 'o'} <> '')
"""


def chunk_sql(source: str, size: int = 1000, overlap: int = 200) -> str:
    """CTEs that end in ``chunked`` (doc_id, chunk_id, chunk, total_chunks) over rows (doc_id, text) of ``source``.

    Level by level, a text is cut before the coarsest separator in it; runs of pieces
    shorter than ``size`` are groups, longer pieces go to the next level.  A group's chunks
    follow from the sums of its pieces' lengths, one chunk a step.
    """
    marks = ["chr(10) || chr(10)", "chr(10)", "' '"]
    parts = [f"n0 as (select doc_id, []::integer[] as path, text, 0 as k from ({source}) where length(text) > 0)"]
    for level in range(4):
        cut = " ".join(f"when {j} then list_transform(str_split(text, {m}), lambda x, i: case when i = 1 then x else {m} || x end)" for j, m in enumerate(marks))
        found = " ".join(f"when k <= {j} and contains(text, {m}) then {j}" for j, m in enumerate(marks))
        parts += [
            f"a{level} as (select *, case {found} else 3 end as s from n{level})",
            f"l{level} as (select doc_id, path, s, list_filter(case s {cut} else regexp_extract_all(text, '(?s).') end, lambda x: x <> '') as pieces from a{level})",
            f"p{level} as (select doc_id, path, s, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i from l{level})",
            f"q{level} as (select *, length(piece) >= {size} and s < 3 as big, (sum((length(piece) >= {size} and s < 3)::int) over (partition by doc_id, path order by i))::int as bigs from p{level})",
            f"g{level} as (select doc_id, list_append(path, 2 * bigs) as key, list(piece order by i) as pieces from q{level} where not big group by doc_id, path, bigs)",
            f"n{level + 1} as (select doc_id, list_append(path, 2 * bigs - 1) as path, piece as text, s + 1 as k from q{level} where big)",
        ]
    parts += [
        "groups as (" + " union all ".join(f"select * from g{level}" for level in range(4)) + ")",
        "sums as (select doc_id, key, pieces, list_prepend(0::bigint, list_transform(range(1, len(pieces) + 1), lambda j: list_sum(list_transform(pieces[1:j], lambda x: length(x)))::bigint)) as p from groups)",
        f"""steps as (
  select doc_id, key, 0::bigint as a, (len(list_filter(p, lambda x: x <= {size})) - 1)::bigint as b, len(pieces) as n, p from sums
  union all
  select doc_id, key, c, (len(list_filter(p, lambda x: x <= p[c + 1] + {size})) - 1)::bigint, n, p
  from (select doc_id, key, n, p, least(b, len(list_filter(p, lambda x: x < greatest(p[b + 1] - {overlap}, p[b + 2] - {size}))))::bigint as c from steps where b < n))""",
        f"cuts as (select t.doc_id, t.key, t.a, {_STRIP % 'array_to_string(g.pieces[t.a + 1 : t.b], $$$$)'} as chunk from steps t join groups g on t.doc_id = g.doc_id and t.key = g.key)",
        "chunked as (select doc_id, (row_number() over (partition by doc_id order by key, a) - 1)::int as chunk_id, chunk, (count(*) over (partition by doc_id))::int as total_chunks from cuts where chunk <> '')",
    ]
    return "with recursive " + ",\n".join(parts)
