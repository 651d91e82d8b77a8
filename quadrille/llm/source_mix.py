"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time, its source's words so far divided by the source's target. All
entries are range-sorted by it and cut where their words reach the total budget. Nothing here is sorted in one task:
a source's running sum is taken over buckets of its shuffled order, the total one over sort ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, materialize, range_parts, scratch, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
#: Documents of a bucket, about; buckets are at least so many. Their number doesn't change the mix, only its tasks.
BUCKET, BUCKETS = 1 << 14, 64
SEED = 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Sources weigh `weights`, repeating, in code point order, null last. They share `share` of all sizes by weight; a
    target stops at `repeat` times its source's size, and the excess is shared again until none is above. Each round
    is one aggregate over the sources, of which only two sums reach the driver.
    """
    ranked = global_rank(sizes, ["source"], "_rank", "sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", pick).drop("_rank"), "weights")
    top = F.col("source_size") * F.lit(repeat)
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level = budget / weight if weight else 0.0
    while weight:
        full = top <= F.col("weight") * F.lit(level)
        capped, open_weight = table.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (budget - (capped or 0)) / open_weight
        if raised <= level:
            break
        level = raised
    return table.withColumn("target", F.least(top.cast("double"), F.col("weight") * F.lit(level)))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    repeat: int = REPEAT,
    seed: int = SEED,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, finish (of its first copy), copies, taken.

    Whole documents are taken, a document at most `repeat` times; in pass p it finishes when p whole passes and the
    documents before it in the source's shuffled order have gone by. A source ends within about a document of its target.

    * null text or no word: size 0, taken 0. Null source: a source of its own, last.
    * rows that repeat an id are documents of their own, shuffled by id and text. Rows without an id are shuffled by text
      and their place in the input.
    * equal finish times: by id, then by text and place. Empty table, or no words at all: all taken 0. Other columns are
      ignored, whatever their names. Reruns agree: the shuffle is a hash.
    """
    with scratch(df.sparkSession) as keep:
        placed, copies = _mixed(df, id_col, F.lit(None).cast("long"), weights, share, repeat, seed, bucket)
        keep(placed)
    return _chosen(placed, copies, id_col)


def _chosen(placed: DataFrame, copies: Column, id_col: str, *more: str) -> DataFrame:
    return placed.select(
        F.col("_id").alias(id_col),
        "source",
        "size",
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        _finish(0).alias("finish"),
        copies.cast("int").alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
        *more,
    )


def _finish(p: int) -> Column:
    """The virtual finish time in pass p."""
    return F.try_divide(F.col("_upto") + F.lit(p) * F.col("source_size"), F.col("target"))


def _mixed(
    df: DataFrame, id_col: str, row: Column, weights: tuple, share: float, repeat: int, seed: int, bucket: int
) -> tuple[DataFrame, Column]:
    """(written rows _row, _id, _u, source, size, _upto, source_size, target; how often each is taken)."""
    # Rows without an id would all stand at one place of the shuffled order; these go by text and place.
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    sized = df.select(
        row.alias("_row"),
        F.col(id_col).alias("_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), place, F.col("text")).alias("_u"),
    )
    sized = materialize(sized, "sized")
    # Buckets are ranges of the shuffled order, so that their number decides nothing.
    bits = max(BUCKETS.bit_length() - 1, (sized.count() // bucket).bit_length())
    sized = sized.withColumn("_b", F.shiftrightunsigned("_u", 64 - bits))
    cells = sized.groupBy("source", "_b").agg(F.sum("size").alias("_cell"))
    cells = materialize(cells, "cells")
    aims = targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, share, repeat)
    aims = materialize(aims, "targets")
    run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(run), F.lit(0))).drop("_cell")
    cells = cells.alias("c").join(aims.alias("a"), F.expr("c.source <=> a.source")).select("c.*", "source_size", "target")
    joined = sized.alias("d").join(cells.alias("c"), F.expr("d.source <=> c.source and d._b = c._b"))
    joined = joined.select("d.*", "c._before", "c.source_size", "c.target")
    within = Window.partitionBy("source", "_b").orderBy("_u", F.col("_id").asc_nulls_last(), "size")
    upto = F.col("_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = materialize(joined.withColumn("_upto", upto).drop("_before", "_b"), "placed")
    entries = placed.filter("size > 0").select(
        "_id", "_u", "size", F.posexplode(F.array(*[_finish(p) for p in range(repeat)])).alias("_pass", "_f")
    )
    order = ["_f", "_id", "_u", "_pass"]
    asc = [F.col(c).asc_nulls_last() for c in order]
    dealt = range_parts(entries, asc, "entries")
    budget = (aims.agg(F.sum("target")).first()[0]) or 0.0
    before, cut = 0, None
    for part, words in dealt.groupBy("_part").agg(F.sum("size")).orderBy("_part").toLocalIterator():
        if before + words > budget + 1e-6:
            total = F.sum("size").over(Window.partitionBy("_part").orderBy(*asc).rowsBetween(Window.unboundedPreceding, 0))
            rows = dealt.filter(F.col("_part") == part).withColumn("_total", total + F.lit(before))
            # The entry on the border goes in if that leaves the total nearer to the budget.
            near = F.col("_total") - F.col("size") / 2 <= F.lit(budget)
            last = rows.filter(near).orderBy(*[F.col(c).desc_nulls_first() for c in order]).select(*order).first()
            cut = last or (float("-inf"), None, 0, -1)
            break
        before += words
    if cut is None:
        copies = F.lit(repeat)
    else:
        f, i, u, _ = (F.lit(x) for x in cut)
        copies = F.lit(0)
        for k in range(repeat):
            # The order of `asc`, against the last entry that is in.
            same = F.col("_id").eqNullSafe(i)
            sooner = F.col("_id").isNotNull() if cut[1] is None else F.coalesce(F.col("_id") < i, F.lit(False))
            tie = (~same & sooner) | (same & ((F.col("_u") < u) | ((F.col("_u") == u) & F.lit(k <= cut[3]))))
            copies = copies + F.when((_finish(k) < f) | ((_finish(k) == f) & tie), 1).otherwise(0)
    return placed, F.when(F.col("size") > 0, copies).otherwise(0)


def mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    repeat: int = REPEAT,
    seed: int = SEED,
    bucket: int = BUCKET,
) -> DataFrame:
    """The rows of df as often as the mix takes them, with their columns as they were; the order says nothing.

    Every row is taken as often as `mix` says of it, also where ids are null or repeat. Null and empty texts are not taken.
    Empty table: empty.
    """
    row, count = "__quadrille_row", "__quadrille_copies"
    with scratch(df.sparkSession) as keep:
        # Rows get a number that the write fixes: ids may repeat.
        numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
        placed, copies = _mixed(numbered, id_col, F.col(row), weights, share, repeat, seed, bucket)
        keep(numbered, placed)
    taken = _chosen(placed, copies, id_col, "_row").filter("copies > 0")
    taken = taken.select(F.col("_row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(count))
    out = numbered.join(taken, row).withColumn(count, F.explode(count))
    return out.select(*[numbered[c] for c in df.columns])
