"""Merkle dataset manifest: parent-preimage paths.

A document is a leaf, the SHA-256 of its fields (`-` for null, else the number of UTF-8
bytes, a colon and the value).  Within a source leaves are ordered by id; every
``fanout`` consecutive nodes become the SHA-256 of their hashes laid end to end, until one
node is left, the source's subroot.  Subroots, ordered by source, give the root likewise.

What is stored is each parent's *preimage*: the hex hashes of its children, concatenated.
A path is the preimages above a node with the node's slot in each, passed down from the
root: a parent's path is its own parent's preimage in front of its parent's path.  Leaves
join the path of their parent.  Taking the own 64 characters out of a preimage leaves the
siblings, which are the proof; putting another hash in their place and hashing again,
upwards, folds a leaf to the root that it claims.

Defined results: null ids come before all others, and rows that share an id are ordered by
their leaf, so equal rows are interchangeable; null is the first source; an empty text is
`0:`; an empty table has no rows and no root; a single leaf is its own subroot, and a
single subroot the root, with an empty proof; rows without an id are not tampered with;
other columns are ignored, whatever their names.

Scale: texts are read once, hashed in the JVM and left behind.  Positions come from ranges
of (source, id) with the counts of the ranges before, so a source with a third of all rows
is as many ranges as its rows need.  A level has a ``fanout``-th of the rows below, and all
joins of nodes are on (source, parent), which at most ``fanout`` children share.  Only
counts and the root reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, tasks, written

FANOUT = 16
HASH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RANGE_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of fields that say how long they are."""
    parts = []
    for x in fields:
        value = x.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, source, hash, ...) with ``tree`` (the source's number), ``i`` (place within it, from 0) and ``n`` (its rows); and the sources (tree, source, n, trees).

    Rows are dealt into ranges of (source, id).  A row's place is its place within its range
    and source, plus the source's rows in the ranges before; a source's number is its place
    among those that begin in its first range, plus those that begin in the ranges before.
    """
    parts = tasks(rows.sparkSession, -(-rows.count() // range_rows))
    keys = [F.col(c).asc_nulls_first() for c in ("source", "id", "hash", "_tie")]
    dealt = written(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    counts = written(dealt.groupBy("_range", "source").agg(F.count("*").alias("_c")), "merkle-counts")
    begun = counts.groupBy("source").agg(F.min("_range").alias("_first"), F.sum("_c").alias("n"))
    # one row for each range that a source begins in
    firsts = begun.groupBy("_first").agg(F.count("*").alias("_c")).select(F.col("_first").alias("_f"), F.coalesce(F.sum("_c").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("trees"))
    place = F.row_number().over(Window.partitionBy("_first").orderBy(F.col("source").asc_nulls_first()))
    sources = begun.join(firsts, F.col("_first") == F.col("_f")).select((F.col("_before") + place - 1).cast("long").alias("tree"), "source", "n", "trees")
    sources = written(sources, "merkle-sources")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    starts = starts.select(F.col("_range").alias("_r"), F.col("source").alias("_g"), "_before", "tree", "n")
    local = F.row_number().over(Window.partitionBy("_range", "source").orderBy(*keys[1:]))
    joined = dealt.join(starts, (F.col("_range") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_g")))
    return joined.withColumn("i", (F.col("_before") + local - 1).cast("long")).drop("_tie", "_range", "_r", "_g", "_before", "source"), sources


def levels(nodes: DataFrame, most: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Parents level by level from nodes (tree, i, n, hash): tree, i, n (nodes of the tree at that level), hash, preimage.

    ``most`` is the largest tree's number of nodes.  A tree's last level is the one with n = 1.
    """
    found = []
    while most > 1:
        child = F.struct((F.col("i") % fanout).alias("slot"), "hash")
        parents = (
            nodes.where("n > 1").groupBy("tree", F.expr(f"i div {fanout}").alias("i"))
            .agg(F.first("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["hash"]), "").alias("preimage"))
            .select("tree", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2("preimage", 256).alias("hash"), "preimage")
        )
        nodes = written(parents, "merkle-level")
        found.append(nodes)
        most = -(-most // fanout)
    return found


def _step(preimage: Column, i: Column, fanout: int) -> Column:
    return F.array(F.struct(preimage.alias("preimage"), (i % fanout).cast("int").alias("slot")))


def with_paths(nodes: DataFrame, above: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` (tree, i, n, ...) with ``path`` to the tree's top and what ``tops`` (tree, path, ...) has for the tree.

    Paths are passed down: each level's parents take theirs from the level above.
    """
    extra = [c for c in tops.columns if c not in ("tree", "path")]

    def from_top(rows: DataFrame) -> DataFrame:
        return rows.where("n = 1").join(tops, "tree")

    held = None
    for rows in [*reversed(above), nodes]:
        found = from_top(rows)
        if held is not None:
            upper = held.select("tree", F.col("i").alias("_parent"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), *extra)
            joined = rows.where("n > 1").withColumn("_parent", F.expr(f"i div {fanout}")).join(upper, ["tree", "_parent"])
            path = F.concat(_step(F.col("_preimage"), F.col("i"), fanout), F.col("_path"))
            found = found.unionByName(joined.withColumn("path", path).select(found.columns))
        held = found
    return held


def siblings(path: Column) -> Column:
    """The proof: all hashes of a path but the node's own and its ancestors', level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HASH), F.substr(p["preimage"], p["slot"] * HASH + HASH + 1))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to, spliced into each preimage in place of the hash that is there."""
    spliced = lambda h, p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HASH), h, F.substr(p["preimage"], p["slot"] * HASH + HASH + 1))
    return F.aggregate(path, leaf, lambda h, p: F.sha2(spliced(h, p), 256))


@dataclass(frozen=True)
class Manifest:
    """A dataset's tree: ``leaves`` (kept columns, tree, i, n, hash), ``parents`` of each level, ``sources`` (tree, source, hash: subroot, i, n), ``source_parents``, ``root`` (None: no rows)."""

    leaves: DataFrame
    parents: list[DataFrame]
    sources: DataFrame
    source_parents: list[DataFrame]
    root: str | None
    fanout: int

    def paths(self) -> DataFrame:
        """Leaves with ``path`` (the preimages above, with the slot in each), ``subroot`` and ``root``."""
        spark = self.leaves.sparkSession
        root = spark.createDataFrame([(0, self.root)], "tree int, root string").withColumn("path", F.expr("cast(array() as array<struct<preimage: string, slot: int>>)"))
        tops = with_paths(self.sources.withColumnRenamed("tree", "_sid").withColumn("tree", F.lit(0)), self.source_parents, root, self.fanout)
        return with_paths(self.leaves, self.parents, tops.select(F.col("_sid").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), self.fanout)


def build(leaves: DataFrame, fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> Manifest:
    """The tree over ``leaves`` (id, source, hash, any more columns), ordered by id within a source."""
    nodes, known = numbered(leaves, range_rows)
    most, trees = known.agg(F.max("n"), F.max("trees")).first()
    nodes = written(nodes, "merkle-nodes")
    parents = levels(nodes.select("tree", "i", "n", "hash"), most or 0, fanout)
    tops = nodes.where("n = 1").select("tree", "hash")
    for level in parents:
        tops = tops.unionByName(level.where("n = 1").select("tree", "hash"))
    sources = written(known.join(tops, "tree").select("tree", "source", "hash", F.col("tree").alias("i"), F.col("trees").alias("n")), "merkle-subroots")
    above = levels(sources.select(F.lit(0).alias("tree"), "i", "n", "hash"), trees or 0, fanout)
    root = (above[-1] if above else sources).select("hash").first()
    return Manifest(nodes, parents, sources, above, root and root[0], fanout)


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", source_col: str = "source", more: dict[str, Column] | None = None, fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> Manifest:
    """The manifest of a table: texts are hashed in one scan; ``more`` are further columns that leaves keep."""
    kept = [x.alias(name) for name, x in (more or {}).items()]
    leaf = leaf_hash([column(c) for c in fields]).alias("hash")
    return build(written(docs.select(column(id_col).alias("id"), column(source_col).cast("string").alias("source"), leaf, *kept), "merkle-hashes"), fanout, range_rows)


def verified(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mod: int = 5, fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Leaf, subroot, root, proof digest and the root folded from each document as it now is.

    Where ``mod`` divides crc32 of the id as text, a document's A-Z have become a-z since.
    """
    hit = F.crc32(column(id_col).cast("string").cast("binary")) % mod == 0
    now = leaf_hash([F.translate(column(c).cast("string"), UPPER, LOWER) if c == text_col else column(c) for c in fields])
    found = manifest(docs, fields, id_col, source_col, {"now": F.when(hit, now)}, fanout, range_rows).paths()
    root = folded(F.coalesce("now", "hash"), F.col("path"))
    out = found.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12(spark, sf_dir: str) -> DataFrame:
    """``op12_merkle_manifest`` over all of ``documents``."""
    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(fields=FIELDS, depth: int = 6, top: int = 3) -> str:
    """SQL for ``op12``: as many levels as 16^6 documents of a source and 16^3 sources need; finished trees pass through."""
    value = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if f == "text" else f) for f in fields) + ")"
    steps = ", ".join(["-1"] * 8)
    crc = f"xor(list_reduce(flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda k: [ord(substr(doc_id::varchar, k, 1))::bigint, {steps}])), lambda c, y: case when y >= 0 then xor(c, y) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295::bigint), 4294967295)"
    up = "select t, i // 16 as i, any_value((n + 15) // 16) as n, string_agg(h, '' order by i) as pre, any_value(n) > 1 as real, case when any_value(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {} group by t, i // 16"
    parts = [
        f"d as (select *, {leaf('text')} as h, case when {crc} % 5 = 0 then {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} end as now from documents)",
        "k as (select source, row_number() over (order by source nulls first) - 1 as t, count(*) over () as trees from (select distinct source from d))",
        "l0 as (select k.t, d.doc_id, d.h, d.now, row_number() over (partition by k.t order by d.doc_id, d.h) - 1 as i, count(*) over (partition by k.t) as n from d join k on d.source is not distinct from k.source)",
        *[f"l{x + 1} as ({up.format(f'l{x}')})" for x in range(depth)],
        f"s0 as (select 0 as t, k.t as i, trees as n, l{depth}.h from k join l{depth} using (t))",
        *[f"s{x + 1} as ({up.format(f's{x}')})" for x in range(top)],
    ]
    joins, before = "", "select doc_id, l0.h as leaf, l0.t as sid, coalesce(now, l0.h) as f0, '' as p0, s0.h as subroot, "
    before += f"(select h from s{top}) as root"
    joins = " from l0 join s0 on s0.i = l0.t"
    for x in range(depth + top):
        name, i = (f"l{x + 1}", "l0.i") if x < depth else (f"s{x - depth + 1}", "l0.t")
        tree, shift = ("l0.t", x) if x < depth else ("0", x - depth)
        before += f", case when {name}.real then {name}.pre end as pre{x}, (({i} >> {4 * shift}) & 15)::int as slot{x}"
        joins += f" join {name} on {name}.t = {tree} and {name}.i = {i} >> {4 * (shift + 1)}"
    parts.append(f"a0 as ({before}{joins})")
    for x in range(depth + top):
        left, right = f"left(pre{x}, slot{x} * 64)", f"substr(pre{x}, slot{x} * 64 + 65)"
        parts.append(f"a{x + 1} as (select *, case when pre{x} is null then f{x} else sha256({left} || f{x} || {right}) end as f{x + 1}, case when pre{x} is null then p{x} else p{x} || {left} || {right} end as p{x + 1} from a{x})")
    last = depth + top
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root, sha256(p{last}) as proof_sha256, f{last} as folded_root, f{last} = root as verified from a{last}"


ORACLE = _oracle()
