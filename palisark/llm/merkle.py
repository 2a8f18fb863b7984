"""A Merkle manifest of the documents: subtrees of aligned leaves in DuckDB, outer trees and proofs in Spark.

Every document is a leaf; the leaves of a language, in order of doc_id, make a binary tree, and the roots of the
languages make another one above. A tree is cut into buckets at ranks that are multiples of 2**``LEVELS``: below such a cut a bucket's
nodes are those of the whole tree, whatever lies beside it, so each bucket is one Arrow table that a task hands to
DuckDB, which makes level after level with ``sha256(string_agg(h, '' ORDER BY p))``. The roots of the buckets are the
leaves of the next, smaller tree. Going down again, each bucket is met by the proof of its own root (a row, joined by
tree and bucket), and puts its inner siblings before it.

No group is larger than a bucket, also where one language has nearly all rows; ranks come from a range-partitioned sort
and a prefix sum over its partitions, ties split by row number.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisark.session import small_side, written

#: Levels that are made inside a bucket, which has 2**LEVELS leaves.
LEVELS = 10
#: One of so many documents, by the CRC-32 of its decimal doc_id, is tampered with.
TAMPER_EVERY = 7


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value (numbers in decimal)."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """A narrow row for each document: tree (the language), doc_id, leaf, and the leaf after tampering where there is any."""
    col = {c: docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    digest = lambda n_chars: F.sha2(F.concat(*(encoded(n_chars if c == "n_chars" else x) for c, x in col.items())), 256)
    chosen = (F.crc32(col["doc_id"].cast("string")) % TAMPER_EVERY == 0) & col["n_chars"].isNotNull()
    more = col["n_chars"].cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")  # the largest long has a successor, too
    return docs.select(
        F.when(col["lang"].isNull(), "").otherwise(F.concat(F.lit("="), col["lang"])).alias("tree"),
        col["doc_id"].alias("doc_id"),
        digest(col["n_chars"]).alias("h"),
        F.when(chosen, digest(more)).alias("tampered"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within ``tree``, by the columns of ``order``, nulls first) and ``n``, the tree's size.

    The columns of ``order`` must tell all rows of a tree apart: then no value of them, however frequent, is one task's.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id())
    spread = written(spread, "merkle-order").withColumn("part", F.shiftrightunsigned("seq", 33))
    held = spread.groupBy("tree", "part").agg(F.count("*").alias("held"), F.min("seq").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("held").over(tree.orderBy("part")) - F.col("held")
    held = held.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n"))
    joined = spread.join(small_side(held, "merkle-parts"), ["tree", "part"])
    return joined.withColumn("rank", F.col("seq") + F.col("shift")).drop("seq", "part", "shift")


@functools.cache
def _duck():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB"})
    con.execute("SET preserve_insertion_order = false")
    return con


def _levels(bucket: pa.Table, cut: int) -> int:
    """Makes tables l0, l1, ... of the bucket's nodes (p: the place inside the bucket, h: the digest); how many levels it has."""
    con, n = _duck(), bucket.column("n")[0].as_py()
    nodes = bucket.select(["rank", "h"])
    con.register("bucket", nodes)
    con.execute(f"CREATE OR REPLACE TEMP TABLE l0 AS SELECT rank % {1 << cut} AS p, h FROM bucket")
    con.unregister("bucket")
    levels = min(cut, (n - 1).bit_length())
    for j in range(levels):
        con.execute(f"CREATE OR REPLACE TEMP TABLE l{j + 1} AS SELECT p // 2 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l{j} GROUP BY p // 2")
    return levels


def _bucket_root(cut: int):
    def make(bucket: pa.Table) -> pa.Table:
        levels = _levels(bucket, cut)
        [(root,)] = _duck().execute(f"SELECT h FROM l{levels}").fetchall()
        rank, n = bucket.column("rank")[0].as_py(), bucket.column("n")[0].as_py()
        return pa.table({"tree": [bucket.column("tree")[0].as_py()], "rank": [rank >> cut], "n": [-(-n >> cut)], "h": [root]})

    return make


def _buckets(nodes: DataFrame, cut: int):
    return nodes.withColumn("bucket", F.shiftrightunsigned("rank", cut)).groupBy("tree", "bucket")


def climb(nodes: DataFrame, cut: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at each cut, leaves first, and a row (tree, h) for the root of each tree.

    ``nodes``: tree, rank, n, h. Each round leaves a node for a bucket, so there are log2(rows) / cut rounds.
    """
    cuts, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        up = written(_buckets(cuts[-1].select("tree", "rank", "n", "h"), cut).applyInArrow(_bucket_root(cut), "tree string, rank long, n long, h string"), "merkle-cut")
        if most <= 1 << cut:
            return cuts, up.select("tree", "h")
        cuts.append(up)
        most = -(-most >> cut)


def _walk(levels: int, cut: int, start: str, outer: list[str], keep: str, add: str) -> str:
    """Walks all nodes of the tables l0, l1, ... up, from digests that the expression ``start`` gives over l0 and ``bucket``.

    The name of a table with p, the digest x that the walk ends with, and ``steps``: from ``keep``, ``add`` for each step
    (over s, the sibling's digest or null, and left, whether it stands on the left).
    """
    con = _duck()
    con.execute(f"CREATE OR REPLACE TEMP TABLE w AS SELECT p, p AS i, {start} AS x, {keep} AS steps FROM l0 JOIN bucket ON rank % {1 << cut} = p")
    climbs = "sha256(CASE WHEN s IS NULL THEN x WHEN \"left\" THEN s || x ELSE x || s END)"
    for j in range(levels):
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE w2 AS SELECT p, i // 2 AS i, {climbs} AS x, {add} AS steps FROM ("
            f"SELECT w.p, i, x, steps, l{j}.h AS s, i % 2 = 1 AS \"left\" FROM w LEFT JOIN l{j} ON l{j}.p = xor(i, 1))"
        )
        con.execute("DROP TABLE w; ALTER TABLE w2 RENAME TO w")
    for step in outer:
        side, sibling = step[:1], step[1:]
        known = f"'{sibling}'" if side else "NULL"
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE w2 AS SELECT p, i, {climbs} AS x, {add} AS steps FROM ("
            f"SELECT p, i, x, steps, {known} AS s, {side == '<'} AS \"left\" FROM w)"
        )
        con.execute("DROP TABLE w; ALTER TABLE w2 RENAME TO w")
    return "w"


#: A step of a path: empty without a sibling, else the side on which it stands, and its digest.
_STEP = "list_append(steps, CASE WHEN s IS NULL THEN '' WHEN \"left\" THEN '<' || s ELSE '>' || s END)"


def _paths_of(cut: int):
    """The path of each node of a bucket: (tree, rank, steps)."""

    def make(bucket: pa.Table, outer: pa.Table) -> pa.Table:
        con, levels = _duck(), _levels(bucket, cut)
        con.register("bucket", bucket.select(["rank"]))
        walked = _walk(levels, cut, "h", outer.column("steps")[0].as_py(), "CAST([] AS VARCHAR[])", _STEP)
        out = con.sql(f"SELECT rank, steps FROM {walked} JOIN bucket ON rank % {1 << cut} = p").to_arrow_table()
        con.unregister("bucket")
        tree = pa.repeat(bucket.column("tree")[0], len(out))
        return pa.table([tree, out.column("rank"), out.column("steps").cast(pa.list_(pa.string()))], names=["tree", "rank", "steps"])

    return make


def paths(nodes: DataFrame, outer: DataFrame, cut: int) -> DataFrame:
    return _buckets(nodes, cut).cogroup(outer.groupBy("tree", "bucket")).applyInArrow(_paths_of(cut), "tree string, rank long, steps array<string>")


def descend(cuts: list[DataFrame], outer: DataFrame, cut: int = LEVELS) -> DataFrame:
    """The paths (tree, bucket, steps) of the buckets of ``cuts[0]``, from those of the trees' roots (tree, bucket 0, steps)."""
    for nodes in reversed(cuts[1:]):
        outer = paths(nodes, outer, cut).withColumnRenamed("rank", "bucket")
    return outer


def manifest(docs: DataFrame, cut: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (see the contract of the query).

    ``docs`` has doc_id, source, lang, n_chars and text, each of which may be null (a null language is a tree of its own,
    the first one; a null doc_id comes before all others and is never tampered with). Rows with the same doc_id are leaves
    of their own, in order of their digests, equal ones in order of input. A language of one document has its leaf as
    root; a manifest of one document has no siblings, and the digest of no bytes as its proof's. Whole texts of any length
    are hashed where they are read. An empty table gives an empty result. Further columns, whatever their names, play no part.
    """
    rows = written(leaf_rows(docs), "merkle-rows")  # the range partitioning below reads its input twice
    id_type = rows.schema["doc_id"].dataType.simpleString()
    leaves = written(ranked(rows, ["doc_id", "h", "row_no"]).drop("row_no"), "merkle-leaves")
    cuts, subroots = climb(leaves, cut)
    top_cuts, roots = climb(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "h"), ["member"]), cut)
    root = roots.first()
    if root is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = root["h"]
    none = F.array().cast("array<string>")
    start = roots.select("tree", F.lit(0).cast("long").alias("bucket"), none.alias("steps"))
    # Down through the tree of languages: a path for each language, then through each language's own tree.
    member = top_cuts[0].select("tree", "rank", "n", "h", "member")
    tops = paths(member, descend(top_cuts, start, cut), cut)
    tops = member.drop("tree").join(tops.drop("tree"), "rank").select(F.col("member").alias("tree"), F.lit(0).cast("long").alias("bucket"), "steps")
    outer = descend(cuts, written(tops, "merkle-tops"), cut)
    outer = outer.join(subroots.withColumnRenamed("h", "subroot"), "tree")

    def proofs(bucket: pa.Table, outer: pa.Table) -> pa.Table:
        con, levels = _duck(), _levels(bucket, cut)
        con.register("bucket", bucket.select(["rank", "doc_id", "h", "tampered"]))
        walked = _walk(levels, cut, "coalesce(tampered, l0.h)", outer.column("steps")[0].as_py(), "''", "steps || coalesce(s, '')")
        out = con.sql(
            f"SELECT doc_id, h AS leaf, sha256(steps) AS proof_sha256, x AS folded_root FROM {walked} JOIN bucket ON rank % {1 << cut} = p"
        ).to_arrow_table()
        con.unregister("bucket")
        folded = out.column("folded_root")
        same = pa.array([x == root for x in folded.to_pylist()], pa.bool_())
        columns = [out.column("doc_id"), out.column("leaf"), pa.repeat(outer.column("subroot")[0], len(out)), pa.repeat(pa.scalar(root), len(out)), out.column("proof_sha256"), folded, same]
        return pa.table(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _buckets(leaves, cut).cogroup(outer.groupBy("tree", "bucket")).applyInArrow(
        proofs, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
