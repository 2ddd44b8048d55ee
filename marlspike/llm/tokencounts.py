"""Token counts: rollups by source, language and tokenizer version, kept by deltas.

Every change of a document is a signed delta: an insert adds its count, a delete takes
it back, a revision takes back the old count (under the old source, language and
tokenizer version) and adds the new one.  A batch of changes is summed to one row for
each group and written under the batch's id; totals are the sum of all batches.

A commit is idempotent: the batch's folder is complete or absent (Spark's success
marker is written last), a batch that is already complete is not written again, and
one that broke off is overwritten.  ``compact`` folds finished batches into a
snapshot that names them, so readers never count one twice.

Defined results: null source, language or version are groups of their own; a null
count is 0 tokens; groups whose documents and tokens both come to 0 are not listed;
repeated rows in a batch are changes of their own; extra columns are ignored.

Scale: deltas are summed before they are shuffled, so a source with a third of all
rows costs one row for each task; texts are read once, for counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, written

GROUP = ["source", "lang", "tokenizer"]

#: Tokenizer versions that are columns; any other counter can be used by giving its counts.
TOKENIZERS = {
    "space-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "alnum-1": lambda text: F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")),
}


def count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(TOKENIZERS[tokenizer](text), F.lit(0)).cast("long")


def inserts(docs: DataFrame) -> DataFrame:
    """Deltas of new documents (columns source, lang, tokenizer, tokens)."""
    return docs.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(docs: DataFrame) -> DataFrame:
    """Deltas of deleted documents, with the counts they were entered with."""
    return inserts(docs).select(*GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas of documents whose count, source, language or tokenizer version changed."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, folder: str) -> bool:
        p, fs = self._fs(f"{folder}/_SUCCESS")
        return fs.exists(p)

    def _names(self, kind: str) -> list[str]:
        """Complete folders of a kind, in order."""
        p, fs = self._fs(f"{self.path}/{kind}")
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if self._done(f"{self.path}/{kind}/{n}"))

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """(last snapshot, batches folded into it, batches that are not), from one listing of each kind.

        A batch that ends after the listing is in neither, wherever it is listed later.
        """
        batches, snapshots = self._names("batches"), self._names("snapshots")
        if not snapshots:
            return None, set(), batches
        folded = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/names/{snapshots[-1]}").collect()}
        return snapshots[-1], folded, [b for b in batches if b not in folded]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Enter a batch of deltas under its id; False if it is already there."""
        folder = f"{self.path}/batches/{batch}"
        if self._done(folder) or batch in self._state()[1]:
            return False
        deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(folder)
        return True

    def _sum(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        paths = [f"{self.path}/snapshots/{snapshot}"] if snapshot else []
        paths += [f"{self.path}/batches/{b}" for b in batches]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        summed = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        snapshot, _, batches = self._state()
        return self._sum(snapshot, batches)

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; the names it holds are written before it.

        Names and sums come from one listing, so a batch that ends meanwhile stays outside of both.
        One process compacts at a time.
        """
        snapshot, folded, batches = self._state()
        name = "00000000" if snapshot is None else f"{int(snapshot) + 1:08d}"
        self.spark.createDataFrame([(b,) for b in sorted(folded | set(batches))], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names/{name}")
        self._sum(snapshot, batches).write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")


def op10(spark, sf_dir: str) -> DataFrame:
    """``op10_token_rollups`` over all of ``documents``, as a log of four deliveries.

    All documents are inserted with version ``space-1``; the batch is delivered again;
    exact copies (all but the smallest id of each text; a row without id is a copy) are
    deleted; what is left in English is revised to version ``alnum-1``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = written(docs.select("doc_id", "source", "lang", F.sha2(text, 256).alias("mark"), count(text, "space-1").alias("one"), count(text, "alnum-1").alias("two")), "token-counts")
    first = sized.groupBy("mark").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = written(sized.join(first, ["mark", "doc_id"], "left").withColumn("copy", F.col("first").isNull()), "token-log")  # by text and id, so many copies are many keys
    one = judged.withColumns({"tokenizer": F.lit("space-1"), "tokens": F.col("one")})
    two = judged.withColumns({"tokenizer": F.lit("alnum-1"), "tokens": F.col("two")})
    rollup = Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("insert", inserts(one))
    rollup.commit("insert", inserts(one))
    rollup.commit("delete", deletes(one.where("copy")))
    rest = "not copy and lang = 'en'"
    rollup.commit("revise", revisions(one.where(rest), two.where(rest)))
    return rollup.totals()


ORACLE = r"""
with d as (
  select doc_id, source, lang, coalesce(text, '') as text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+')) as one,
    len(regexp_extract_all(coalesce(text, ''), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as two,
    min(doc_id) over (partition by coalesce(text, '')) as first
  from documents),
k as (
  select source, lang, case when lang = 'en' then 'alnum-1' else 'space-1' end as tokenizer, case when lang = 'en' then two else one end as tokens
  from d where doc_id = first)
select source, lang, tokenizer, count(*)::bigint as docs, sum(tokens)::bigint as tokens from k group by all
"""
