"""URL filters: rules by host and path, and for other pages a naive Bayes score of segmented host and path words.

Host labels and path parts that run words together are split by a unigram Viterbi search. The unigram counts come from
the words of all pages; the class counts from all pages that a rule decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize, scratch, small_batches
from .textbytes import LOWER, pieces, utf8, word_hashes, words

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: About so many pages, and letters of distinct runs, are worked on at once, each lot with the part of a model it needs.
SHARD, LETTERS = 1 << 10, 1 << 16
#: Substrings of so many letters at most are looked up whole; a longer word is looked up by its first so many letters.
ANCHOR = 24
THRESHOLD = 0.5

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[97:123] = False


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (after the first `://`, A-Z lower-cased) and path; both empty if url is null or has no `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, UPPER, UPPER.lower()), "path": path})


def rule_columns(rules: list = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) for columns host and path: the longest rule that fits, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each piece of text: runs of the letters a-z, A-Z lower-cased."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for lo, hi in pieces(offsets):
            part = LOWER[data[offsets[lo] : offsets[hi]]]
            start, end, _ = words(part, offsets[lo : hi + 1] - offsets[lo], _NOT_LETTER)
            _, first, n = np.unique(word_hashes(part, start, end), return_index=True, return_counts=True)
            raw = part.tobytes()
            names = [raw[a:b].decode("ascii") for a, b in zip(start[first], end[first], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def unigrams(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """(table of word and n, sum of n, least n) of all words of a one-column table."""
    counts = texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.filter((F.length("word") > 1) | F.col("word").isin("a", "i")), "words")
    found = counts.agg(F.sum("n").alias("total"), F.min("n").alias("least")).first()
    return counts, found.total or 1, found.least or 1


_TEN = math.log(10)


def segment(text: str, logs: dict[str, float], least: float | None = None, lengths: list[int] | None = None) -> list[str]:
    """The likeliest split of a run of letters; a word out of the model costs more the longer it is.

    `least` is the whole model's least value where logs is a part; `lengths` are those of its words, ascending. Linear in
    the text's length for a model of few lengths. Equal scores: the shorter last word. Empty text: no words.
    """
    floor = (min(logs.values(), default=0.0) if least is None else least) - _TEN
    lengths = sorted({len(w) for w in logs}) if lengths is None else lengths
    best, cut = [0.0], [0]
    far, since = -math.inf, 0  # where an unknown word up to here begins at best
    for end in range(1, len(text) + 1):
        value = best[end - 1] + _TEN * (end - 1)
        if value >= far:
            far, since = value, end - 1
        found, where = far + floor - _TEN * end, since
        for n in lengths:
            if n > end:
                break
            log = logs.get(text[end - n : end])
            if log is not None and (best[end - n] + log > found or (best[end - n] + log == found and end - n > where)):
                found, where = best[end - n] + log, end - n
        best.append(found)
        cut.append(where)
    out, end = [], len(text)
    while end:
        out.append(text[cut[end] : end])
        end = cut[end]
    return out[::-1]


def runs(text: str) -> Iterator[str]:
    """Runs of letters, lower-cased, and runs of digits."""
    run = ""
    for c in [*text.lower(), "/"]:
        if run and (c.isalpha() != run[-1].isalpha() or not c.isalnum()):
            yield run
            run = ""
        if c.isalnum():
            run += c


def tokens(host: str, path: str, logs: dict[str, float], memo: dict[str, list[str]]) -> list[str]:
    """Segmented words of host (`h:`) and path (`p:`); digits count as one token by their length. memo: splits so far."""
    out = []
    for kind, text in (("h:", host), ("p:", path)):
        for run in runs(text):
            if run[-1].isalpha():
                if run not in memo:
                    memo[run] = segment(run, logs)
                out += [kind + w for w in memo[run]]
            else:
                out.append(f"{kind}#{len(run)}")
    return out


def _letter_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, run) of each run of letters in host and path."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        seen = {(shard, run) for shard, *texts in rows for text in texts for run in runs(text) if run[-1].isalpha()}
        shards, found = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(found, pa.string())], names=["shard", "run"])


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, word) of what can be a word in a run: the letters a-z, ANCHOR at most."""

    def flush() -> pa.RecordBatch:
        lots, found = zip(*seen, strict=True) if seen else ((), ())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(lots, pa.int32()), pa.array(found, pa.string())], names=["lot", "word"])

    seen: set = set()
    for batch in batches:
        for lot, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for part in re.finditer("[a-z]+", run):
                for a in range(part.start(), part.end()):
                    seen.update((lot, run[a:b]) for b in range(a + 1, min(part.end(), a + ANCHOR) + 1))
                    if len(seen) > 100_000:
                        yield flush()
    yield flush()


def _splits(total: int, least: int):
    def run(lot: pa.Table, known: pa.Table) -> pa.Table:
        logs = {w: math.log(n / total) for w, n in zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True)}
        found, lengths = lot["run"].to_pylist(), sorted({len(w) for w in logs})
        split = [segment(r, logs, math.log(least / total), lengths) for r in found]
        return pa.table({"run": pa.array(found, pa.string()), "split": pa.array(split, pa.list_(pa.string()))})

    return run


def _tokenize(pages: pa.Table, splits: pa.Table) -> pa.Table:
    memo = dict(zip(splits["run"].to_pylist(), splits["split"].to_pylist(), strict=True))
    found = [tokens(h, p, {}, memo) for h, p in zip(pages["host"].to_pylist(), pages["path"].to_pylist(), strict=True)]
    return pages.append_column("tokens", pa.array(found, pa.list_(pa.string())))


def _known(distinct: DataFrame, words_: DataFrame) -> DataFrame:
    """(lot, word, n) of the words that stand in a lot's runs (lot, run)."""
    short = distinct.mapInArrow(_substrings, "lot int, word string").distinct().join(words_, "word")
    # A longer word: its first letters at a place of a run, then the rest, so that no run lists all its substrings.
    long_ = words_.filter(F.length("word") > ANCHOR).withColumn("start", F.substring("word", 1, ANCHOR))
    keyed = distinct.filter(F.length("run") > ANCHOR).withColumn("key", F.xxhash64("run"))
    at = keyed.select("lot", "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("run") - ANCHOR), lambda i: F.substr("run", i, F.lit(ANCHOR)))).alias("at", "start"))
    hits = at.join(long_, "start").join(keyed, ["lot", "key"])
    hits = hits.filter(F.substr("run", F.col("at") + 1, F.length("word")) == F.col("word"))
    return short.select("lot", "word", "n").unionByName(hits.select("lot", "word", "n").distinct())


def tokenize(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Add `shard` and `tokens`, an array, to rows with host and path. The unigram model counts all words of texts.

    No task holds the model: the substrings of the distinct runs are joined to it, and each lot of runs gets the words
    found in it; each shard of rows gets the splits of its runs.
    """
    with scratch(parts.sparkSession) as keep:
        words_, total, least = unigrams(texts)
        parts = materialize(parts.withColumn("_row", F.monotonically_increasing_id()), "parts")
        shards = max(1, -(-parts.count() // SHARD))
        parts = parts.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")).drop("_row")
        found = parts.select("shard", "host", "path").mapInArrow(_letter_runs, "shard int, run string").distinct()
        found = materialize(found, "runs")
        distinct = materialize(found.select("run").distinct(), "distinct_runs")
        lots = max(1, -(-(distinct.agg(F.sum(F.length("run"))).first()[0] or 0) // LETTERS))
        distinct = distinct.select(F.pmod(F.xxhash64("run"), F.lit(lots)).cast("int").alias("lot"), "run")
        known = _known(distinct, words_)
        splits = distinct.groupBy("lot").cogroup(known.groupBy("lot")).applyInArrow(_splits(total, least), "run string, split array<string>")
        own = found.join(materialize(splits, "splits"), "run")
        schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", tokens array<string>"
        out = materialize(parts.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_tokenize, schema), "tokenized")
        keep(out)
    return out


def train(labelled: DataFrame) -> tuple[float, DataFrame, int, int]:
    """(prior, table of token, block and allow, the denominators of both classes) from tokens and verdict of all rows given."""
    block, allow = (F.count_if(F.col("verdict") == v).alias(v) for v in ("block", "allow"))
    pages = labelled.agg(block, allow).first()
    table = materialize(labelled.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(block, allow), "tokens")
    sums = table.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    b, a = ((x or 0) + sums.n + 1 for x in (sums.block, sums.allow))
    return math.log((pages.block + 1) / (pages.allow + 1)), table, b, a


def _score(prior: float, b: int, a: int):
    def run(pages: pa.Table, known: pa.Table) -> pa.Table:
        rows = zip(*(known[c].to_pylist() for c in ("token", "block", "allow")), strict=True)
        odds = {t: math.log((x + 1) / b) - math.log((y + 1) / a) for t, x, y in rows}
        score, split = [], []
        for found in pages["tokens"].to_pylist():
            x = prior + sum(odds.get(t, math.log(a / b)) for t in found)
            score.append(1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
            split.append(" ".join(found))
        out = pages.drop_columns(["shard", "tokens"])
        return out.append_column("score", pa.array(score, pa.float64())).append_column("tokens", pa.array(split, pa.string()))

    return run


def judge(df: DataFrame, rules: list = RULES, threshold: float = THRESHOLD, learn: Column | None = None) -> DataFrame:
    """One row per row of df (page_id, url, html): page_id, host, path, rule, verdict, score, tokens.

    verdict is the rule's, else block if the score reaches the threshold. The unigram model counts all words of html.
    `learn` says by page_id which of the pages that a rule decides Bayes learns from: all, unless some are held out.

    * null url or no `://`: empty host and path, no rule, scored by the prior alone.
    * no page that a rule decides: the score is 0.5 throughout and such pages are allowed.
    * null html counts no words; null page_id and repeated rows are rows of their own. Empty table: empty result. Other
      columns are ignored, whatever their names.
    """
    small_batches(df.sparkSession)
    name, verdict = rule_columns(rules)
    parts = with_parts(df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url")))
    parts = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))
    with scratch(df.sparkSession) as keep:
        parts = tokenize(parts, df.select(F.col("html")))
        ruled = parts.filter("verdict is not null")
        prior, odds, b, a = train(ruled if learn is None else ruled.filter(learn))
        keep(parts, odds)
        learned = not odds.isEmpty()
    # Each shard gets the odds of its own tokens; the table stays whole.
    own = parts.select(F.col("shard").alias("of"), F.explode("tokens").alias("token")).distinct().join(odds, "token")
    schema = "page_id long, host string, path string, rule string, verdict string, score double, tokens string"
    scored = parts.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(_score(prior, b, a), schema)
    method = F.when(F.lit(learned) & (F.col("score") >= threshold), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", method)).select(
        "page_id", "host", "path", "rule", "verdict", "score", "tokens"
    )
