"""Language identification by multilingual mixture inference.

A document is a bag of hashed byte trigrams drawn from a mixture of languages. Expectation-maximisation finds the
proportions from the trigrams' likelihoods; of the nested sets of its likeliest languages, the one of greatest
likelihood less a penalty a language is kept. Sets grow until no larger one can win: the likelihood of any mixture is
bounded by that of the present one and the largest factor by which a round would raise a language's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches
from .textbytes import PIECE, pieces, utf8

#: Trigram buckets, about so many documents to learn a language from.
BUCKETS, SAMPLE = 1 << 13, 4000
#: About so many likelihoods (trigrams by languages) are worked on at once.
CELLS = 1 << 22
FOLDS, HELD = 5, 0
#: Rounds over all languages, and for each nested set.
ROUNDS, MORE = 10, 4
#: Penalty of a language in units of log(trigrams) / 2. Overlapping trigrams tell a thing three times, hence over 1.
PENALTY = 6.0
NONE = "und"

#: Letters keep their bytes, A-Z lower-cased; all other ASCII is a gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def trigram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts [rows, buckets] of the trigrams around each letter, with gaps at a row's ends."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded = np.full(len(data) + rows + 1, 32, np.uint8)
    padded[np.arange(len(data)) + row + 1] = _FOLD[data]
    of = np.zeros(len(padded), np.int64)
    of[np.arange(len(data)) + row + 1] = row
    out = np.zeros(rows * buckets, np.int64)
    for lo in range(1, len(padded) - 1, PIECE):
        hi = min(lo + PIECE, len(padded) - 1)
        mid = np.flatnonzero(padded[lo:hi] != 32) + lo
        code = (padded[mid - 1].astype(np.uint32) << 16) | (padded[mid].astype(np.uint32) << 8) | padded[mid + 1]
        at = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))
        out += np.bincount(of[mid] * buckets + at, minlength=len(out))
    return out.reshape(rows, buckets)


def _language_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), np.int64)
            data, offsets = utf8(batch.column(0))
            for lo, hi in pieces(offsets):
                part = trigram_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets)
                for lang in np.unique(langs[lo:hi]).tolist():
                    found = part[langs[lo:hi] == lang].sum(0)
                    total[lang] = total[lang] + found if lang in total else found
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            cols = [pa.array(np.full(len(at), lang), pa.int64()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "bucket", "n"])

    return run


def train(df: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, trigram probabilities [buckets, languages]) from rows (doc_id, text, lang) with a language.

    Learns every language, from about `sample` whole documents each, chosen by a hash of the id. What reaches the driver is
    a count per language and bucket: 64 KB a language. No labelled row: no languages.
    """
    rows = df.filter("lang is not null")
    found = sorted(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.lang)
    langs = [r.lang for r in found]
    if not langs:
        return [], np.zeros((buckets, 0))
    scale = 1 << 30
    shares = [(r.lang, i, int(scale * min(1.0, sample / r.n))) for i, r in enumerate(found)]
    # One row a language, joined: a condition for each would be too deep a plan.
    drawn = rows.join(F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, _at long, _share long")), "lang")
    chosen = drawn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("_share")).select("text", "_at")
    counts = chosen.mapInArrow(_language_counts(buckets), "lang long, bucket long, n long")
    table: pd.DataFrame = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((buckets, len(langs)))
    total[table["bucket"], table["lang"]] = table["n"]
    total += 0.5
    return langs, total / total.sum(0)


def _proportions(p: np.ndarray, c: np.ndarray, at: np.ndarray, of: np.ndarray, pi: np.ndarray, rounds: int):
    """(proportions, log likelihood) after so many rounds; p [entries, languages], rows begin at `at`."""
    total = np.add.reduceat(c, at)[:, None]
    for _ in range(rounds):
        w = p * pi[of]
        w *= (c / w.sum(1))[:, None]
        pi = np.add.reduceat(w, at, axis=0) / total
    return pi, np.add.reduceat(c * np.log(np.maximum((p * pi[of]).sum(1), 1e-300)), at)


def infer(counts: np.ndarray, probs: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions [rows, languages] of the chosen sets; rows without trigrams are all 0."""
    out = np.zeros((len(counts), probs.shape[1]))
    full = np.flatnonzero(counts.any(1))
    if not len(full) or not probs.shape[1]:
        return out
    cells = np.cumsum(np.count_nonzero(counts[full], axis=1)) * probs.shape[1]
    if len(full) > 1 and cells[-1] > CELLS:
        for some in np.split(full, np.flatnonzero(np.diff(cells // CELLS)) + 1):
            out[some] = _infer(counts[some], probs, penalty)
        return out
    out[full] = _infer(counts[full], probs, penalty)
    return out


def _ceiling(p: np.ndarray, c: np.ndarray, at: np.ndarray, of: np.ndarray, pi: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """What the log likelihood of no mixture exceeds, from one of proportions pi: the log is concave."""
    total = np.add.reduceat(c, at)
    factor = np.add.reduceat(p * (c / (p * pi[of]).sum(1))[:, None], at, axis=0).max(1) / total
    return fit + total * np.log(np.maximum(factor, 1.0))


def _infer(counts: np.ndarray, probs: np.ndarray, penalty: float) -> np.ndarray:
    """infer for rows that all have trigrams."""
    rows, width = len(counts), probs.shape[1]
    of, bucket = np.nonzero(counts)
    c = counts[of, bucket].astype(float)
    at = np.searchsorted(of, np.arange(rows))
    p = probs[bucket]
    pi, fit = _proportions(p, c, at, of, np.full((rows, width), 1.0 / width), ROUNDS)
    most = _ceiling(p, c, at, of, pi, fit)
    order = np.argsort(-pi, axis=1, kind="stable")
    p, pi = np.take_along_axis(p, order[of], 1), np.take_along_axis(pi, order, 1)
    cost = penalty * np.log(np.add.reduceat(c, at) + 1.0) / 2
    best, kept, open_ = np.full(rows, -np.inf), np.zeros_like(pi), np.arange(rows)
    for k in range(1, width + 1):
        some = np.flatnonzero(np.isin(of, open_))
        own = np.searchsorted(open_, of[some])
        first = np.searchsorted(own, np.arange(len(open_)))
        share = np.maximum(pi[open_, :k], 1e-9)
        share, fit = _proportions(p[some, :k], c[some], first, own, share / share.sum(1, keepdims=True), MORE if k > 1 else 0)
        fit = fit - cost[open_] * (k - 1)
        better = fit > best[open_]
        won = open_[better]
        best[won], kept[won] = fit[better], 0.0
        kept[won, :k] = share[better]
        open_ = open_[most[open_] - cost[open_] * k > best[open_]]
        if not len(open_):
            break
    out = np.zeros((rows, width))
    np.put_along_axis(out, order, kept, 1)
    return out


def _predict(langs: list[str], probs: np.ndarray, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            data, offsets = utf8(column)
            for lo, hi in pieces(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                mixture = infer(trigram_counts(part, own, probs.shape[0]), probs, penalty)
                ascii_letters = np.append(0, np.cumsum((_FOLD[part] >= 97) & (_FOLD[part] < 123)))
                plain = ascii_letters[own[1:]] > ascii_letters[own[:-1]]
                names, scores, mixed = [], [], []
                for i in range(hi - lo):
                    # Only texts without an ASCII letter are asked for others.
                    known = len(langs) and (plain[i] or any(x.isalpha() for x in column[lo + i].as_py() or ""))
                    best = int(mixture[i].argmax()) if known else 0
                    names.append(langs[best] if known else NONE)
                    scores.append(float(min(1.0, mixture[i, best])) if known else 0.0)
                    some = np.flatnonzero(mixture[i] > 0) if known else []
                    mixed.append(",".join(f"{langs[j]}:{mixture[i, j]:.3f}" for j in some))
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(df: DataFrame, langs: list[str], probs: np.ndarray, penalty: float = PENALTY) -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score (its share of the document), mixture (shares of the chosen set).

    * null or empty text, or no letter: `und`, score 0, no mixture. No language learned: `und` for all.
    * letters of which no language is likelier, as in scripts never seen: the first language in code point order.
    * null doc_id and repeated rows: rows of their own. Empty table: empty. Other columns are ignored.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_predict(langs, probs, penalty), "doc_id long, lang_pred string, score double, mixture string")


def held_out(id_: Column = None) -> Column:
    return crc_mod(F.col("doc_id") if id_ is None else id_, FOLDS) == HELD


def predict_all(df: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row; adds held_out."""
    small_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, probs = train(rows.filter(~held_out()))
    out = identify(rows, langs, probs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
