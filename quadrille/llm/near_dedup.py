"""Near-duplicate classes: SetSketch bands propose, a joint likelihood screens, full shingle sets decide.

1. One pass over the texts gives each document the size and fingerprint of its shingle set and its registers' band keys.
2. Equal sets collapse to a representative, by a minimum that is combined before the shuffle.
3. Representatives that share a band key meet in a bucket; a second pass keeps registers and sets of these documents only.
   A bucket never lists its pairs: each round, some pivots are drawn from it and every other member that isn't yet in the
   pivot's class is held against them. The join itself compares sizes, one bit a register and, after the first round,
   the shingles of a document that other candidates have at all, which leaves few pairs.
   Used pivots leave the bucket, and a bucket whose members are one class is done; so the rounds end, and by then every
   pair of a bucket was tested or already connected. Classes of copies close after the first rounds.
4. Pairs that are left are joined with registers and full sets: what the joint likelihood of the registers leaves is
   decided by the sets.

With 36 bands of 5 registers, a pair at similarity 0.85 shares no band with probability 7e-10; the bits and the likelihood
each lose one with less than 1e-9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .common import materialize, scratch, small_batches
from .components import components
from .textbytes import LOWER, SPACES, U64, mix, pieces, shingles, utf8, word_hashes, words

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Pairs whose estimate is this far below are not compared in full: a binomial tail of 3e-10 at 180 registers.
SLACK = 0.2
#: Longs of the bitmap of a document's shared shingles.
MAP = 16
MAPS = [f"map{i}" for i in range(MAP)]
#: Chance at which a pair at the threshold may differ in more register bits than allowed.
TAIL = 1e-9
#: Pivots of a bucket by round; later rounds take four times as many as the one before. A bucket with no more members than
#: that is done in the round. The first numbers are small, so that classes have closed before many pivots meet their members.
PIVOTS = (1, 8, 64, 4096)
#: Most ids of a broadcast; more are joined by a shuffle.
BROADCAST = 500_000
#: Members of a bucket that meet its pivots in one task; a larger bucket is dealt over several.
SPLIT = 2048

_BANDS = "doc_id long, mark long, n_shingles long, fp1 long, fp2 long, bit1 long, bit2 long, bit3 long, bands array<long>"
_SETS = "doc_id long, n_shingles long, regs binary, shingles binary"


def _sketch(k: int, keep_sets: bool):
    """Sketches of rows (doc_id, text, mark), or of rows (doc_id, text) the registers and sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in pieces(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                start, end, row = words(part, own, SPACES)
                grams, of = shingles(word_hashes(part, start, end), row, hi - lo, k)
                sets, n = [], np.zeros(hi - lo, np.int64)
                borders = np.searchsorted(of, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    sets.append(np.unique(grams[borders[i] : borders[i + 1]]))
                    n[i] = len(sets[-1])
                flat, of = np.concatenate(sets), np.repeat(np.arange(hi - lo), n)
                regs = setsketch.registers(flat, of, hi - lo)
                if keep_sets:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, hi - lo),
                            pa.array(n),
                            pa.array([r.tobytes() for r in regs], pa.binary()),
                            pa.array([s.tobytes() for s in sets], pa.binary()),
                        ],
                        names=["doc_id", "n_shingles", "regs", "shingles"],
                    )
                    continue
                fp = np.zeros((2, hi - lo), U64)
                full = np.flatnonzero(n)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    fp[0, full] = np.add.reduceat(mix(flat), at)
                    fp[1, full] = np.bitwise_xor.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), at)
                keys = setsketch.band_keys(regs)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                cols = [batch.column(c).slice(lo, hi - lo) for c in (0, 2)] + [pa.array(n), *(pa.array(x.view(np.int64)) for x in fp)]
                cols += [*(pa.array(np.ascontiguousarray(x)) for x in low_bits(regs).T), bands]
                names = ["doc_id", "mark", "n_shingles", "fp1", "fp2", "bit1", "bit2", "bit3", "bands"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def hashes(data: bytes) -> np.ndarray:
    """A stored set's hashes, sorted."""
    return np.frombuffer(data, "<u8").astype(U64)


def low_bits(regs: np.ndarray) -> np.ndarray:
    """The lowest bit of each register, as three longs a row."""
    wide = np.zeros((len(regs), 192), np.uint8)
    wide[:, : regs.shape[1]] = regs & 1
    return np.packbits(wide, axis=1).view(np.int64)


def most_unequal(percent: int, registers: int = setsketch.REGISTERS, tail: float = TAIL) -> int:
    """The least number of unequal bits that a pair at the threshold exceeds with a chance below the tail."""
    p = (100 - percent) / 200
    left = 1.0
    for i in range(registers + 1):
        left -= math.comb(registers, i) * p**i * (1 - p) ** (registers - i)
        if left < tail:
            return i
    return registers


def _confirm(percent: int, floor: float):
    """Pairs (a, b) by their registers' joint likelihood, then by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int16).reshape(batch.num_rows, -1) for c in (2, 3)]
            sizes = [batch.column(c).to_numpy().astype(float) for c in (4, 5)]
            linked = setsketch.joint_estimate(*regs, *sizes) >= floor
            for i in np.flatnonzero(linked):
                x, y = (hashes(batch.column(c)[i].as_py()) for c in (6, 7))
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return run


def _among(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of df with a doc_id in the table ids, of n rows."""
    return df.join(F.broadcast(ids) if n <= BROADCAST else ids, "doc_id", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are near enough."""
    names = ["regs", "n_shingles", "shingles"]
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = materialize(ids, "ids")
    some = _among(sets, ids, ids.count())
    left, right = (some.select(F.col("doc_id").alias(side), *[F.col(n).alias(n + side) for n in names]) for side in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", *[n + side for n in names for side in "ab"])
    return both.mapInArrow(_confirm(percent, percent / 100 - SLACK), "a long, b long")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            some = batch.slice(lo, 64)
            sets = [hashes(x) for x in some.column(1).to_pylist()]
            ids = np.repeat(some.column(0).to_numpy(), [len(x) for x in sets])
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat)], names=["doc_id", "shingle"])


def _shared_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, common, map0, map1, ...): how many shingles others have too, and a bitmap of these shingles' low bits."""
    for batch in batches:
        common, maps = [], np.zeros((batch.num_rows, 64 * MAP), np.uint8)
        for i, (x, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
            shared = hashes(x)
            if own.is_valid:
                shared = np.setdiff1d(shared, own.values.to_numpy().view(U64), assume_unique=True)
            common.append(len(shared))
            maps[i, (shared & U64(64 * MAP - 1)).astype(np.int64)] = 1
        longs = np.packbits(maps, axis=1).view(np.int64).reshape(-1, MAP)
        cols = [batch.column(0), pa.array(common, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in longs.T)]
        yield pa.RecordBatch.from_arrays(cols, names=["rep", "common", *MAPS])


def _with_shared(state: DataFrame, sets: DataFrame) -> DataFrame:
    """Set `common` and the maps from the shingles of a document that any other document still in a bucket has.

    Twice a pair's intersection is no larger than both documents' common shingles less the bits that only one map has. This
    rules out copies that were edited in too many places to link, however many of them meet in a bucket.
    """
    ids = materialize(state.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    some = _among(sets.select("doc_id", "shingles"), ids, ids.count())
    rows = some.mapInArrow(_shingle_rows, "doc_id long, shingle long")
    once = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    own = once.groupBy("doc_id").agg(F.collect_list("shingle").alias("own"))
    facts = some.join(own, "doc_id", "left").select("doc_id", "shingles", "own")
    facts = facts.mapInArrow(_shared_map, "rep long, common long, " + ", ".join(f"{m} long" for m in MAPS))
    return state.drop("common", *MAPS).join(facts, "rep")


def _open(state: DataFrame) -> DataFrame:
    """Bucket rows of buckets with members of two classes or more, and their `size`."""
    keys = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
    return state.drop("size").join(keys.filter("lo != hi").select("key", "size"), "key")


def _candidates(state: DataFrame, p: int, percent: int, unequal: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b that may link; the pivots used: key, rep). A bucket gives at most p pivots, which travel to its parts."""
    facts = ["rep", "n_shingles", "common", *MAPS, *BITS]
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    slot = F.when(F.col("size") <= p, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep"), F.lit(p)))
    drawn = state.groupBy("key", slot.alias("slot")).agg(
        F.min(F.struct(F.xxhash64("rep").alias("h"), "comp", *facts)).alias("at"), F.max("size").alias("size")
    )
    every = (F.col("size") <= p).alias("every")
    pivots = drawn.select("key", every, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(f"at.{n}").alias(f"p_{n}") for n in ["comp", *facts]])
    dealt = state.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "rep"), parts).cast("int"))
    least, total = F.least("common", "p_common"), F.col("n_shingles") + F.col("p_n_shingles")
    # Bits that only one of the two maps has count against both sides' common shingles.
    unlike = sum((F.bit_count(F.col(m).bitwiseXOR(F.col("p_" + m))) for m in MAPS), F.lit(0))
    shared = (F.col("common") + F.col("p_common") - unlike) / 2
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"p_{b}"))) for b in BITS), F.lit(0))
    enough = lambda most: F.lit(100) * most >= F.lit(percent) * (total - most)
    # Where every member is a pivot, a pair meets twice.
    once = ~F.col("every") | (F.col("rep") < F.col("p_rep"))
    near = (F.col("comp") != F.col("p_comp")) & once & enough(least) & (apart <= unequal) & enough(shared)
    pairs = dealt.join(pivots, ["key", "part"]).filter(near)
    pairs = pairs.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
    return pairs, drawn.select("key", F.col("at.rep").alias("rep"))


def _links(rows: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, component) of the sets that link with another; None if none does."""
    bands = reps.select("rep", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("size"))
    state = materialize(bands.join(shared.filter("lo != hi").select("key", "size"), "key"), "buckets")
    active = materialize(state.select("rep").distinct(), "active")
    n = active.count()
    if not n:
        return None
    facts = reps.select("rep", "n_shingles", *BITS)
    none = [F.lit(0).cast("long").alias(m) for m in MAPS]
    state = state.join(facts, "rep").withColumns({"comp": F.col("rep"), "common": F.col("n_shingles")}).select("*", *none)
    state = materialize(state, "state")
    # A set's text is that of any row with the representative's id and mark.
    wanted = reps.join(F.broadcast(active) if n <= BROADCAST else active, "rep", "left_semi").select("rep", "doc_id", "mark")
    wanted = wanted.alias("w") if n > BROADCAST else F.broadcast(wanted).alias("w")
    texts = rows.alias("r").join(wanted, F.expr("r.mark = w.mark and r.doc_id <=> w.doc_id")).select(F.col("rep").alias("doc_id"), "text")
    sets = materialize(texts.mapInArrow(_sketch(k, True), _SETS), "sets")
    if sets.count() != n:
        sets = materialize(sets.dropDuplicates(["doc_id"]), "sets")
    unequal, labels, turn = most_unequal(percent), None, 0
    while not state.isEmpty():
        p = PIVOTS[min(turn, len(PIVOTS) - 1)] * 4 ** max(0, turn - len(PIVOTS) + 1)
        with scratch(rows.sparkSession) as keep:
            pairs, used = _candidates(state, p, percent, unequal)
            found = materialize(_linked(materialize(pairs, "pairs"), sets, percent), "found")
            state = state.join(used, ["key", "rep"], "left_anti")
            if not found.isEmpty():
                # Known classes go in as stars, so only the new links have to be worked through.
                stars = None if labels is None else labels.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                labels = materialize(components(found if stars is None else found.unionByName(stars)), "labels")
                state = state.drop("comp").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                state = state.withColumn("comp", F.coalesce("component", "rep")).drop("component")
            state = materialize(_open(state), "buckets")
            if turn == 0:
                state = materialize(_with_shared(state, sets), "shared")
            keep(state, labels)
        turn += 1
    return labels


BITS = ["bit1", "bit2", "bit3"]


def _marked(df: DataFrame) -> DataFrame:
    """doc_id, text and mark, a hash of the text: rows that agree in id and mark are the same document."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("mark"))


def _labelled(df: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, mark, n_shingles, fp1 and fp2 (the set's), least (its class's smallest id), top1 and top2 (the set that stays)."""
    spark = df.sparkSession
    small_batches(spark)
    rows = _marked(df)
    with scratch(spark) as keep:
        sketched = materialize(rows.mapInArrow(_sketch(k, False), _BANDS), "sketched")
        # Nodes are the distinct sets, known by a number that the write fixes; an id with several texts is several nodes.
        whose = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", *BITS, "bands")
        first = sketched.filter("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min(whose).alias("own"))
        first = first.select("fp1", "fp2", "n_shingles", "own.doc_id", "own.mark", *[f"own.{b}" for b in BITS], "own.bands")
        reps = materialize(first.withColumn("rep", F.monotonically_increasing_id()), "reps")
        labels = _links(rows, reps, k, percent)
        own = reps.select("rep", "fp1", "fp2", "n_shingles", F.col("doc_id").alias("least"), F.col("fp1").alias("top1"), F.col("fp2").alias("top2"))
        if labels is None:
            named = own
        else:
            linked = own.join(labels.withColumnRenamed("node", "rep"), "rep").drop("top1", "top2")
            top = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp1", "fp2")).alias("top")
            tops = linked.groupBy("component").agg(top).select("component", "top.least", F.col("top.fp1").alias("top1"), F.col("top.fp2").alias("top2"))
            linked = linked.drop("least").join(tops, "component").drop("component")
            named = own.join(labels.select(F.col("node").alias("rep")), "rep", "left_anti").unionByName(linked)
        named = materialize(named.drop("rep"), "named")
        keep(sketched, named)
    every = sketched.select("doc_id", "mark", "n_shingles", "fp1", "fp2")
    return every.join(named, ["fp1", "fp2", "n_shingles"], "left")


def _stays() -> Column:
    """Whether a row of `_labelled` has its class's smallest id, or without any id the set that stands for the class."""
    mine = (F.col("fp1") == F.col("top1")) & (F.col("fp2") == F.col("top2"))
    return F.when(F.col("n_shingles") == 0, True).when(F.col("doc_id").isNull(), F.col("least").isNull() & mine).otherwise(F.col("doc_id") == F.col("least"))


def classes(df: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept, and set_id (equal for equal shingle sets).

    * null, empty or blank text: no shingles, linked with nothing, component_id is the document's own id, kept.
    * fewer than k words: the whole sequence is the only shingle.
    * null doc_id: linked like others; component_id is the smallest id reachable, null if there is none. Kept only in a
      class without ids, and there in one set.
    * a doc_id with several texts: every row is linked by its own text. Rows that repeat a doc_id and text: each returned,
      same values. Empty table: empty. Other columns are ignored, whatever their names.
    """
    out = _labelled(df, k, percent)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), _stays().alias("kept"), F.hex("fp1").alias("set_id"))


def deduplicate(df: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of df for each class, with its columns as they were: one with the class's smallest id.

    * null, empty or blank text: linked with nothing, so all such rows stay.
    * a class without any id: one row of it stays. An id with several texts: each text goes or stays by its own class; in
      a class where the smallest id has several texts, one of them stays.
    * rows that repeat the id and text that stay: the one whose columns, as JSON, are the greatest text. Empty table: empty.
    """
    id_, mark = "__quadrille_id", "__quadrille_mark"
    with scratch(df.sparkSession) as keep:
        rows = materialize(_labelled(df, k, percent).filter("n_shingles > 0").withColumn("stays", _stays()), "labelled")
        least = F.min(F.struct("fp1", "fp2", "mark")).alias("one")
        one = rows.filter("stays").groupBy("top1", "top2").agg(least).select("top1", "top2", F.col("one.mark").alias("one"))
        rows = rows.join(one, ["top1", "top2"]).select("doc_id", "mark", (F.col("stays") & (F.col("mark") == F.col("one"))).alias("stays"))
        counts = rows.groupBy("doc_id", "mark").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
        counts = materialize(counts.filter("not stays or n > 1"), "counts")
        # Rows that go; and, of what stays, rows that are there several times.
        gone = counts.filter("not stays or n > 1").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
        many = counts.filter("stays").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
        keep(counts)
        repeated = not many.isEmpty()
    same = lambda t: df["doc_id"].cast("long").eqNullSafe(t[id_]) & (F.xxhash64(df["text"]) == t[mark])
    out = df.join(gone, same(gone), "left_anti")
    if not repeated:
        return out
    whole = df.join(many, same(many), "left_semi")
    row = F.struct(*[whole[c] for c in whole.columns])
    once = whole.groupBy(whole["doc_id"].alias(id_), whole["text"].alias(mark)).agg(F.max_by(row, F.to_json(row)).alias("__quadrille_row"))
    return out.unionByName(once.select("__quadrille_row.*"))
