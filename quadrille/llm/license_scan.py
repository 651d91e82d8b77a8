"""License scans by diagonal voting.

Every k-word gram of every text is joined to the positions that it has in the templates. Hits of one template on one
diagonal (text position less template position) are votes for an alignment; a hit counts if its words are the template's.
Votes of neighbouring diagonals merge, so an inserted or missing word doesn't break a match; a merged span counts if it
covers enough of the template. Labels that two-word phrases name are found the same way, with grams of two words and the
whole phrase on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .license_texts import NOTICES
from .textbytes import LOWER, NOT_ALNUM, U64, grams, pieces, utf8, word_hashes, words

#: Phrases that name a licence on their own.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
GRAM = 3
#: Neighbouring diagonals are one alignment if they are at most so far apart: words, and share of the template's grams.
SLACK, DRIFT = 2, 0.1
#: Share of a notice's grams that a span must hold, in as many words at most as the notice has, by this factor.
COVER, STRETCH = 0.6, 1.5
_MARK = 0x5EED0FD0C5  # an element that each text has, so that texts without a hit stay in the result


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words, each with a space after it; where each begins)."""
    size = end - start + 1
    ends = np.cumsum(size)
    at = ends - size
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    from_ = np.repeat(start - at, size) + np.arange(len(out))
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = data[from_[inside]]
    return out, at


def _grams(k_phrase: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in pieces(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                start, end, row = words(part, own, NOT_ALNUM)
                hashes = word_hashes(part, start, end)
                count = np.bincount(row, minlength=hi - lo)
                left = (np.cumsum(count)[row] if len(row) else row) - np.arange(len(row))
                sizes = [np.maximum(count - j + 1, 0) for j in (k_phrase, k)]
                size = sizes[0] + sizes[1] + 1
                ends = np.cumsum(size)
                flat = np.empty(int(ends[-1]), np.int64)
                flat[ends - 1] = _MARK
                base = ends - size
                first = np.cumsum(count) - count
                for shift, j in ((np.zeros_like(base), k_phrase), (sizes[0], k)):
                    at = np.flatnonzero(left >= j)
                    flat[(base + shift)[row[at]] + at - first[row[at]]] = grams(hashes, at, j).view(np.int64)
                lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(flat))
                text, begins = _joined(part, start, end)
                borders = np.append(begins, len(text))[np.append(first, len(start))]
                texts = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(text)])
                places = pa.ListArray.from_arrays(np.append(first, len(start)).astype(np.int32), pa.array((begins - borders[row]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(count), texts, places, lists],
                    names=["_row", "doc_id", "n_words", "words", "begins", "grams"],
                )

    return run


def template_grams(text: str, k: int) -> list[tuple[int, bytes]]:
    """(hash, words with a space after each) of the k-grams of a template, as the kernel has them."""
    data, offsets = utf8(pa.array([text]))
    data = LOWER[data]
    start, end, _ = words(data, offsets, NOT_ALNUM)
    found = grams(word_hashes(data, start, end), np.arange(max(0, len(start) - k + 1)), k).astype(U64).view(np.int64).tolist()
    own = [data[a:b].tobytes() + b" " for a, b in zip(start, end, strict=True)]
    return [(h, b"".join(own[i : i + k])) for i, h in enumerate(found)]


def spans(df: DataFrame, phrases: dict = PHRASES, notices: list = NOTICES, k: int = GRAM) -> DataFrame:
    """The verified spans: _row (place in the input), doc_id, n_words, label, base, first and last word, cover."""
    return _spans(df, phrases, notices, k).filter("label is not null")


def _spans(df: DataFrame, phrases: dict, notices: list, k: int) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark, 500)
    k_phrase = min(len(p.split()) for p in phrases)
    table, n = [(_MARK, -1, None, False, 0, 1, 0, b"")], 0
    for base, entries in ((True, [(v, p) for p, v in phrases.items()]), (False, notices)):
        for label, text in entries:
            width = k_phrase if base else k
            own = template_grams(text, width)
            table += [(h, n, label, base, i, len(own), width, w) for i, (h, w) in enumerate(own)]
            n += 1
    templates = spark.createDataFrame(table, "gram long, template int, label string, base boolean, at int, size int, k int, said binary")
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    listed = rows.mapInArrow(_grams(k_phrase, k), "_row long, doc_id long, n_words long, words binary, begins array<int>, grams array<long>")
    each = listed.select("_row", "doc_id", "n_words", "words", "begins", F.posexplode("grams").alias("_i", "gram"))
    # The template table is as large as the template list, not as the data.
    hits = each.join(F.broadcast(templates), "gram")
    others = F.greatest(F.col("n_words") - (k_phrase - 1), F.lit(0))
    place = F.when(F.col("base"), F.col("_i")).otherwise(F.col("_i") - others)
    hits = hits.withColumn("_at", place.cast("long"))
    # A hit is one only if its words are the template's: equal hashes alone don't vote.
    begin = F.try_element_at("begins", (F.col("_at") + 1).cast("int"))
    same = F.substr(F.col("words"), begin + 1, F.octet_length("said")) == F.col("said")
    hits = hits.filter((F.col("template") < 0) | same)
    hits = hits.select("_row", "doc_id", "n_words", "template", "label", "base", "at", "size", "k", "_at")
    hits = hits.withColumn("diagonal", F.when(F.col("template") < 0, 0).otherwise(F.col("_at") - F.col("at")))
    keys = ["_row", "doc_id", "n_words", "template", "label", "base", "size", "k"]
    votes = hits.groupBy(*keys, "diagonal").agg(
        F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.collect_set("at").alias("ats")
    )
    line = Window.partitionBy("_row", "template").orderBy("diagonal")
    slack = F.when(F.col("base"), 0).otherwise(F.greatest(F.lit(SLACK), F.floor(F.col("size") * DRIFT)))
    votes = votes.withColumn("_new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > slack, F.lit(True)).cast("int"))
    votes = votes.withColumn("_span", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy(*keys, "_span").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held")
    )
    spans = spans.withColumn("cover", F.col("held") / F.col("size")).withColumn("last", F.col("hi") + F.col("k") - 1)
    wide = (F.col("last") - F.col("lo") + 1) <= (F.col("size") + F.col("k") - 1) * F.lit(STRETCH)
    good = F.when(F.col("base"), F.col("held") == F.col("size")).otherwise((F.col("cover") >= COVER) & wide)
    return spans.filter((F.col("template") < 0) | good).select(
        "_row", "doc_id", "n_words", "label", "base", F.col("lo").alias("first"), "last", "cover"
    )


def labels(df: DataFrame, phrases: dict = PHRASES, notices: list = NOTICES, k: int = GRAM) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    n_base counts all places of phrases, first_word and last_word are their smallest and largest start; score is the
    best covered share of a template.

    * null, empty or wordless text: n_words 0, no labels (the empty string), null places, score 0.
    * null doc_id and repeated rows: rows of their own, known by their place in the input. Empty table: empty result.
    * phrases that repeat or overlap: each place counts. Other columns are ignored, whatever their names.

    Rows are told apart by their place, so a lost executor's part must read alike again: hand over files or written tables.
    """
    found = _spans(df, phrases, notices, k)
    base, start = F.col("base"), F.col("first")

    def names(which):
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))

    mine = F.col("label").isNotNull()
    out = found.groupBy("_row", "doc_id", "n_words").agg(
        F.count(F.when(mine & base, 1)).alias("n_base"),
        F.min(F.when(mine & base, start)).alias("first_word"),
        F.max(F.when(mine & base, start)).alias("last_word"),
        names(mine & base).alias("base_labels"),
        names(mine).alias("labels"),
        F.coalesce(F.max(F.when(mine, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.count(F.when(mine & ~base, 1)).alias("n_spans"),
    )
    return out.drop("_row")
