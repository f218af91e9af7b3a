"""Exact duplicates by skew-safe combining; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters that do not count, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: An id's place in a rank: 20 decimal digits hold every 64-bit id, counted from the least.
PLACE = "100000000000000000000"
LEAST = "9223372036854775808"


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One decimal, larger for more code points, then for a smaller id; a null id comes after all others."""
    wide = lambda c: c.cast("decimal(38,0)")
    place = F.coalesce(wide(doc_id) + F.lit(LEAST).cast("decimal(38,0)"), F.lit(PLACE).cast("decimal(38,0)") - 1)
    return (wide(n_chars) * F.lit(PLACE).cast("decimal(21,0)") + (F.lit(PLACE).cast("decimal(38,0)") - 1 - place)).cast("decimal(38,0)")


def _id(rank: Column) -> Column:
    place = F.lit(PLACE).cast("decimal(38,0)") - 1 - (rank % F.lit(PLACE).cast("decimal(38,0)"))
    return F.when(place < F.lit(PLACE).cast("decimal(38,0)") - 1, (place - F.lit(LEAST).cast("decimal(38,0)")).cast("long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same without white space ([\\x20\\x09-\\x0D]); null is
    empty. Of equal texts the row with most code points stays, then the smallest id (a null id last;
    of several rows that agree in both, all count as kept).

    Three stages combine equal texts, each grouping by the digest and the whole normalised text:
    within a task (partial aggregation), within a salt of the digest, and over the salts. A group
    of a third of all rows thus reaches a task of the second stage as at most one row for each earlier task
    and salt, and a task of the third as one row for each salt. Rows find their group by
    the 256-bit digest, the length and a second hash, in a join whose large keys can be split; singletons do not take part.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = base.select(
        "doc_id",
        F.translate("t", SPACES, "").alias("norm"),
        F.char_length("t").alias("n_chars"),
    ).select(
        "doc_id",
        "norm",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        _rank(F.col("n_chars"), F.col("doc_id")).alias("rank"),
    )
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.lit(salts)).cast("int")
    salted = rows.withColumn("salt", salt).groupBy("digest", "salt", "norm").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    groups = salted.groupBy("digest", "norm").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    several = groups.where("n > 1").select("digest", F.xxhash64("norm").alias("other"), F.octet_length("norm").alias("size"), "n", F.col("rank").alias("best"))
    members = rows.select("doc_id", "digest", F.xxhash64("norm").alias("other"), F.octet_length("norm").alias("size"), "rank")
    alone = F.col("n").isNull()
    return members.join(several, ["digest", "other", "size"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(_id(F.col("best"))).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rank") == F.col("best"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
