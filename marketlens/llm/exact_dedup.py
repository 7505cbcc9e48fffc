"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only rows whose length is shared go on to the prefix hash, and only rows whose
(length, prefix hash) is shared have their whole text hashed. Each step is a scan that
counts with map-side aggregation, so a group holding a third of all rows costs one
partial row per task, and hands the next a bit table of the shared values (of bounded size; it lets
few others through, which the next step sorts out). A bit table is one array, built by an aggregate,
written once and read as a scalar subquery: it is no part of the plan's text, but every use of it is
part of the tasks, so rows are written with their digests instead of asking the tables in every branch.
A scan normalises each text once: what follows are columns of it, never conditions, which Spark would
move below the columns and so repeat them. Only texts of rows in a group cross the network, and only where the rows themselves are
wanted. DataFrame functions only.

Null text counts as empty. Rows repeating both text and id share one decision;
``deduplicate`` keeps one of them. A null id stays only if its whole group has null
ids. Empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sha256_text

PREFIX_CHARS = 256
SALTS = 16
FILTER_WORDS = 1 << 18


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _slot(words: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(words * 64))


def _may_be_in(shared: DataFrame):
    """Column condition, true for every row whose columns are a row of ``shared`` (and for few others).

    One 64-bit word for each shared value, FILTER_WORDS words (2 MB) at most. Where that fills up, beyond
    some million shared values, more rows go on to the next step; the groups stay exact.
    """
    shared = materialize(shared, "shared-values")
    n_words = max(1, min(FILTER_WORDS, shared.count()))
    slot = _slot(n_words, *[F.col(c) for c in shared.columns])
    words = shared.select(slot.alias("s")) \
        .groupBy(F.shiftright("s", 6).cast("int").alias("word")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("mask"))
    every = shared.sparkSession.range(n_words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    table = words.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask")) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("bits"))
    bits = materialize(table, "copy-filter").scalar()
    discard(shared)

    def test(*cols: Column) -> Column:
        word = F.get(bits, F.shiftright(_slot(n_words, *cols), 6).cast("int"))
        return F.call_function("shiftright", word, _slot(n_words, *cols).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def _suspects(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __n, the normalised text, and __may: true for every row that shares length and prefix hash with another, and for few others."""
    sized = docs.withColumn("__n", normalized(F.col(text_col))) \
        .withColumns({"__len": F.length("__n"), "__prefix": F.xxhash64(F.substring("__n", 1, PREFIX_CHARS))})
    one = sized.select(F.col("__len").alias("len")).groupBy("len").agg(F.count("*").alias("c")).where("c > 1").select("len")
    sized = sized.withColumn("__may", _may_be_in(one)(F.col("__len")))
    # Rows of a length of their own count as one null group.
    two = sized.select(F.when(F.col("__may"), F.col("__len")).alias("len"), F.when(F.col("__may"), F.col("__prefix")).alias("prefix")) \
        .groupBy("len", "prefix").agg(F.count("*").alias("c")).where("c > 1").select("len", "prefix")
    return sized.withColumn("__may", F.col("__may") & _may_be_in(two)(F.col("__len"), F.col("__prefix"))).drop("__len", "__prefix")


def _groups(suspects: DataFrame) -> DataFrame:
    """Groups of two or more equal digests among ``suspects`` (id, digest)."""
    return suspects.groupBy("digest", "id").agg(F.count("*").alias("c")) \
        .groupBy("digest") \
        .agg(F.min("id").alias("keep_id"), F.sum("c").alias("group_size"),
             F.coalesce(F.min_by(F.col("c"), F.col("id")), F.max("c")).alias("keep_rows")) \
        .where("group_size > 1")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: (digest, keep_id, group_size, keep_rows).

    ``keep_rows`` counts the rows that carry the kept id.
    """
    return _groups(_digests(docs, id_col, text_col).where("may").select("id", "digest"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id and digest, and whether it may be in a group; written once."""
    return materialize(_suspects(docs, text_col).select(F.col(id_col).alias("id"), sha256_text(F.col("__n")).alias("digest"),
                                                        F.col("__may").alias("may")), "text-digests")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's decision: id, keep_id, group_size, kept, text_sha256, keep_rows."""
    digests = _digests(docs, id_col, text_col)
    groups = _groups(digests.where("may").select("id", "digest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = digests.select("id", "digest") \
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    j = rows.join(groups, ["digest", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return j.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                    F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"),
                    F.coalesce("keep_rows", F.lit(1)).alias("keep_rows"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The rows are written once with the digests of those that may be in a group, and the groups are written once; only
    rows that may be in one cross the network to meet them. The second branch runs only where rows repeat both id and text.
    """
    # A null digest stands for a row that no other can equal; its text is not hashed whole.
    marked = materialize(_suspects(docs, text_col).select(*docs.columns, F.when(F.col("__may"), sha256_text(F.col("__n"))).alias("__d")), "copy-digests")
    groups = materialize(_groups(marked.where("__d is not null").select(F.col(id_col).alias("id"), F.col("__d").alias("digest"))), "copy-groups")
    grouped = F.coalesce(_may_be_in(groups.select("digest"))(F.col("__d")) & F.col("__d").isNotNull(), F.lit(False))
    salted = groups.select(
        F.col("digest").alias("__dg"), F.col("keep_id").alias("__keep"), F.col("keep_rows").alias("__rows"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    met = marked.where(grouped).withColumn("__s", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")) \
        .join(salted, (F.col("__d") == F.col("__dg")) & (F.col("__s") == F.col("__salt")), "left") \
        .where(F.col("__dg").isNull() | F.col(id_col).eqNullSafe(F.col("__keep")))
    out = list(docs.columns)
    alone = marked.where(~grouped).select(*out)
    if groups.where("keep_rows > 1").isEmpty():
        return alone.unionByName(met.select(*out))
    single = F.coalesce(F.col("__rows"), F.lit(1)) == 1
    repeated = met.where(~single).dropDuplicates([id_col, "__d"])
    return alone.unionByName(met.where(single).select(*out)).unionByName(repeated.select(*out))
