"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition is a run of (digest, smallest identifier, count). The runs meet in binomial rounds: runs and
digests have an address of base-``fan_in`` digits; in round r a run's r-th address digit is replaced by that of each of
its digests, so that ``fan_in`` runs exchange slices and each receiver merges the ``fan_in`` slices it gets. After
log(runs) rounds every digest has one entry, at its own address, and no task has ever held more than its share: a digest
that a third of all rows carry has one entry a run after the first round, not a third of the rows. Equal digests of a
task are combined before they are sent, too.

Only digests and identifiers move; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisark.session import fresh_name, small_side, written

FAN_IN = 16
#: Copies of one text from which its rows are joined with its entry by broadcast, not in the task of its digest.
HOT_COPIES = 10_000
#: The white space that doesn't count: runs of these bytes are one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text that is compared: null is empty, each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row for each document: row number, id, SHA-256, and length and a second hash that verify a match."""
    text = normalised(docs[text_col])
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        docs[id_col].alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("verify"),
    )


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each distinct text: digest, n_bytes, verify, first (its smallest row) and group_size.

    Two texts are one only if digest, length and the second hash agree: so each merge verifies what it joins.
    A null identifier is larger than any other; of rows that have the same identifier the first in input order counts.
    """
    run = F.shiftrightunsigned("row_no", 33)
    n_runs = (rows.agg(F.max(run)).first()[0] or 0) + 1
    rounds = 1
    while fan_in**rounds < n_runs:
        rounds += 1
    address = F.pmod(F.col("verify"), F.lit(fan_in**rounds))
    level = rows.select(
        "digest", "n_bytes", "verify", run.alias("cell"), F.lit(1).cast("long").alias("group_size"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no").alias("first"),
    )
    for r in range(rounds):
        digit = lambda x, r=r: F.pmod(F.floor(x / fan_in**r), F.lit(fan_in))
        level = (
            level.withColumn("cell", F.col("cell") + (digit(address) - digit(F.col("cell"))) * fan_in**r)
            .groupBy("cell", "digest", "n_bytes", "verify")
            .agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
        )
    return level.drop("cell")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (see ``normalised``) the row with the smallest id stays; exactly one row of each group is kept, also
    where ids repeat. Null and empty texts are one group. An empty table gives an empty result. Other columns of the
    input play no part, whatever their names.
    """
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    merged = merge_runs(rows, fan_in)
    # A text of very many copies would bring all its rows into one task of a join by digest; there are few such texts.
    key = ["digest", "n_bytes", "verify"]
    merged = written(merged, "merged")
    hot = small_side(merged.where(F.col("group_size") >= HOT_COPIES), "hot")
    joined = rows.join(hot.select(key), key, "left_anti").join(merged, key).unionByName(rows.join(hot, key))
    return joined.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The documents without their exact copies, all columns unchanged, whatever their names.

    Only identifiers of rows that go or that repeat are joined with the texts; the join is on the identifier, which has
    no hot value but null, and rows without an identifier are told apart by their digest. An empty table stays empty.
    """
    found = groups(docs, id_col, text_col, fan_in)
    digest = F.sha2(normalised(docs[text_col]), 256)
    stays = fresh_name("stays", docs.columns)
    # What happens to the rows of one identifier and digest: of `n` equal rows one or none stays.
    fate = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.bool_or("kept").alias(stays)).where(f"n > 1 or not {stays}")
    fate = small_side(fate.drop("n"), "fates")
    same = docs[id_col].eqNullSafe(fate["doc_id"]) & (digest == fate["text_sha256"])
    columns = [docs[f"`{c}`"] for c in docs.columns]
    alone = docs.join(fate, same, "left_anti")
    repeated = docs.join(fate.where(stays), same)
    one, two = (fresh_name(x, docs.columns) for x in ("id", "sha"))
    repeated = repeated.select(*columns, fate["doc_id"].alias(one), fate["text_sha256"].alias(two)).dropDuplicates([one, two])
    return alone.unionByName(repeated.drop(one, two))
