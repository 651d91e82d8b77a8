"""Exact dedup by skew-safe combining, in DataFrame functions only.

Equal texts meet three times, and each time the whole text is part of the grouping key: in the map side of the first
exchange (equal texts of one partition), in salted digest groups (the salt is the partition that a row was read in, so
one task holds at most a row a partition of a `salts`-th of them), and in the groups of salt winners (at most `salts`
rows of a text). Rows then learn of their class by digest; digests that several texts share are looked up by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, scratch

SALTS = 64
#: Bytes of SHA-256 that grouping goes by; fewer only serve to test texts that share one.
WIDTH = 32

_FAST, _SLOW = "__quadrille_fast", "__quadrille_slow"


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _digest(norm: Column, width: int) -> Column:
    return F.substring(F.unhex(F.sha2(norm, 256)), 1, width)


def _grouped(df: DataFrame, id_col: str, text_col: str, salts: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: _id, _digest, _salt; texts: _digest, keep_id, group_size; digests that several texts share), all written."""
    base = df.select(F.col(id_col).alias("_id"), _normal(F.col(text_col)).alias("_norm"))
    base = base.withColumns({"_digest": _digest(F.col("_norm"), width), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
    rows = materialize(base.select("_id", "_digest", "_salt"), "rows")
    texts = materialize(_by_text(base).drop("_norm"), "texts")
    clashes = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_digest")
    return rows, texts, materialize(clashes, "clashes")


def _by_text(base: DataFrame) -> DataFrame:
    """(_digest, _norm, keep_id, group_size): salted groups first, then their winners."""
    salted = base.groupBy("_digest", "_norm", "_salt").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_norm").agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, width: int = WIDTH) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z. The largest id of a class stays.

    * null text: the empty text; all empty texts are one class.
    * null id: counts in group_size; is kept only if its class has no id, and then keep_id is null.
    * one id with several texts: each row belongs to its text's class and may stay there.
    * rows that repeat an id and text: every one is returned, all with the same values.
    * empty table: empty result. Other columns are ignored, whatever their names.
    """
    with scratch(df.sparkSession) as keep:
        rows, texts, clashes = _grouped(df, id_col, text_col, salts, width)
        keep(rows, texts)
        clash = not clashes.isEmpty()
        if clash:
            keep(clashes)
    plain = texts.join(clashes, "_digest", "left_anti") if clash else texts
    # Each salt of a digest that rows have gets the class, so that a class of many rows is joined in many tasks.
    spread = rows.groupBy("_digest", "_salt").agg(F.lit(1).alias("_one")).drop("_one").join(plain, "_digest")
    found = rows.join(spread, ["_digest", "_salt"])
    sha = F.lower(F.hex("_digest"))
    if clash:
        base = df.select(F.col(id_col).alias("_id"), _normal(F.col(text_col)).alias("_norm"))
        base = base.withColumns({"_digest": _digest(F.col("_norm"), width), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
        base = base.join(clashes, "_digest", "left_semi")
        own = base.join(_by_text(base), ["_digest", "_norm"]).withColumn("_sha", F.sha2("_norm", 256))
        found = found.withColumn("_sha", sha if width == WIDTH else F.lit(None).cast("string")).unionByName(own.drop("_norm"))
        sha = F.col("_sha")
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept, sha.alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, width: int = WIDTH) -> DataFrame:
    """One row of df for each text, with its columns as they were: the row with the largest id.

    * null text is the empty text. A null id stays only if no equal text has an id.
    * one id with several texts: every text stays once, under the largest id that it has.
    * rows that repeat the largest id and text: the one whose columns, as JSON, are the greatest text stays.
    * empty table: empty result.
    """
    with scratch(df.sparkSession) as keep:
        rows, texts, clashes = _grouped(df, id_col, text_col, salts, width)
        top = texts.select("_digest", F.col("keep_id").alias("_id"))
        same = (F.col("r._digest") == F.col("t._digest")) & F.col("r._id").eqNullSafe(F.col("t._id"))
        counts = rows.groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        repeated = counts.alias("r").join(top.alias("t"), same, "left_semi").select("_digest")
        # Texts of which one look at id and digest can't tell a single row; all their rows are compared whole.
        slow = materialize(clashes.unionByName(repeated).distinct(), "slow")
        some = not slow.isEmpty()
        fast = materialize(top.join(slow, "_digest", "left_anti") if some else top, "kept")
        keep(fast)
        if some:
            keep(slow)
    own = _digest(_normal(df[text_col]), width)
    fast = fast.select(F.col("_digest").alias(_FAST), F.col("_id").alias(_SLOW))
    out = df.join(fast, (own == fast[_FAST]) & df[id_col].eqNullSafe(fast[_SLOW]), "left_semi")
    if not some:
        return out
    slow = slow.select(F.col("_digest").alias(_SLOW))
    whole = df.join(slow, own == slow[_SLOW], "left_semi")
    row = F.struct(*[whole[c] for c in whole.columns])
    one = whole.groupBy(_normal(whole[text_col]).alias(_FAST)).agg(
        F.max_by(row, F.struct(whole[id_col].alias("i"), F.to_json(row).alias("j"))).alias(_SLOW)
    )
    return out.unionByName(one.select(F.col(_SLOW + ".*")))
