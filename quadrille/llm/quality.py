"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from what it says, as hashed words and word pairs, and how it
looks, as shares of kinds of letters and words; gated attention weighs the passages, and the weighted representation is
scored. Only document labels are learned from.

Training runs on the executors: bags are dealt into groups by a hash, each round every group takes its steps from the
same parameters, bag after bag, and the driver averages what they come to. The driver holds parameters only, a task a
few bags.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, scratch, small_batches
from .textbytes import LOWER, SPACES, U64, mix, pieces, utf8, word_hashes, words

#: Words of a passage; labelled documents to learn from at most; widths of encoding and attention.
PASSAGE, SAMPLE, WIDTH, GATE = 64, 6000, 16, 8
#: Groups that learn side by side, rounds of averaging, and bags of a step.
GROUPS, ROUNDS, BATCH = 4, 12, 8
#: Buckets of hashed words and word pairs, and by how much less than looks they weigh at first.
GRAMS, FAINT = 256, 4.0
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
SEED = 5

_KIND = np.full(256, 3, np.int64)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True
LOOKS = 22
FEATURES = LOOKS + GRAMS


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features [passages, FEATURES], row); a row without words has one passage of zeros.

    First the looks, then for each bucket the root of its share of the passage's words and word pairs.
    """
    rows = len(offsets) - 1
    start, end, row = words(data, offsets, SPACES)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    n_pass = np.maximum(1, -(-count // size))
    base = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    of_row = np.repeat(np.arange(rows), n_pass)
    if not len(start):
        return np.zeros((total, FEATURES), np.float32), of_row
    of = base[row] + (np.arange(len(row)) - first[row]) // size
    length = end - start
    hashes = word_hashes(LOWER[data], start, end)

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[end] - sums[start]

    def share(values: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, total) / np.maximum(by, 1)

    n = np.bincount(of, minlength=total)
    kinds = [per_word(_KIND[data] == k) for k in range(5)]
    size_ = np.bincount(of, length, total)
    letters = kinds[0] + kinds[1] + kinds[4]
    same = np.zeros(len(row))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    pair = np.zeros(len(row), U64)
    # A pair lies within one passage.
    pair[1:] = np.where(of[1:] == of[:-1], mix(hashes[:-1] * U64(0xD6E8FEB86659FD93) + hashes[1:]), U64(0))

    def distinct(h: np.ndarray) -> np.ndarray:
        keys = mix(h + of.astype(U64) * U64(0x9E3779B97F4A7C15))
        _, at = np.unique(keys, return_index=True)
        return np.bincount(of[at], minlength=total) / np.maximum(n, 1)

    last = data[end - 1]
    mean = size_ / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(share(length.astype(float) ** 2, n) - mean**2, 0))
    breaks = np.append(0, np.cumsum(data == 10))
    gap = np.zeros(len(row))
    gap[1:] = (breaks[start[1:]] > breaks[end[:-1]]) & (row[1:] == row[:-1])
    out = [
        mean / 10, spread / 10, np.log1p(n) / 4,
        *(share(k, size_) for k in kinds),
        share((letters == kinds[1]) & (letters > 1), n), share(letters == 0, n), share(length == 1, n), share(same, n),
        distinct(hashes), distinct(pair), share(kinds[1] > 0, n), share(_MARKS[last], n),
        share((_KIND[last] == 3) & ~_MARKS[last], n), share(per_word(_KIND[data] == 3) > 1, n), share(length > 20, n),
        share(gap, n), share((kinds[2] > 0) & (letters > 0), n), share(kinds[2] == length, n),
    ]
    said = np.zeros(total * GRAMS)
    for h in (hashes, pair[1:][pair[1:] != 0]):
        own = of if len(h) == len(of) else of[1:][pair[1:] != 0]
        said += np.bincount(own * GRAMS + (mix(h) >> U64(56)).astype(np.int64), minlength=len(said))
    said = np.sqrt(said.reshape(total, GRAMS) / np.maximum(2 * n, 1)[:, None])
    return np.concatenate([np.stack(out, 1), said], 1).astype(np.float32), of_row


class Model:
    """Gated attention over encoded passages; plain arrays, so it travels in a closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        shapes = {"W": (len(mean), WIDTH), "b": (WIDTH,), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "a": (GATE,), "c": (WIDTH,), "d": ()}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
        self.one, self.two = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
        self.steps = 0

    def forward(self, x: np.ndarray, of: np.ndarray, at: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        w = np.exp(e - np.maximum.reduceat(e, at)[of])
        w /= np.add.reduceat(w, at)[of]
        z = np.add.reduceat(w[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "w": w, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def step(self, x: np.ndarray, of: np.ndarray, at: np.ndarray, label: np.ndarray, decay: float) -> dict:
        """Gradients of the mean log loss."""
        p, f = self.p, self.forward(x, of, at)
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["c"]
        dw = (dz[of] * f["h"]).sum(1)
        de = f["w"] * (dw - np.add.reduceat(f["w"] * dw, at)[of])
        dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["w"][:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grads = {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(),
        }
        return {k: g + decay * p[k] for k, g in grads.items()}

    def learn(self, bags: Iterator[tuple[np.ndarray, float]], steps: int, done: int, planned: int, rate: float = 0.02, decay: float = 1e-3) -> int:
        """Adam over so many steps of BATCH bags each, or to the end of the bags; how many were taken."""
        taken = 0
        while taken < steps and (some := list(itertools.islice(bags, BATCH))):
            x, of = np.concatenate([b for b, _ in some]).astype(float), np.repeat(np.arange(len(some)), [len(b) for b, _ in some])
            at = np.searchsorted(of, np.arange(len(some)))
            grads = self.step(x, of, at, np.array([y for _, y in some]), decay)
            taken += 1
            self.steps += 1
            now = rate * (0.5 * (1 + np.cos(np.pi * min(1.0, (done + taken) / max(1, planned)))) + 0.02)
            for k, g in grads.items():
                self.one[k] = 0.9 * self.one[k] + 0.1 * g
                self.two[k] = 0.999 * self.two[k] + 0.001 * g * g
                self.p[k] = self.p[k] - now * (self.one[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.two[k] / (1 - 0.999**self.steps)) + 1e-8)
        return taken

    def flat(self) -> np.ndarray:
        """All that learning changes, as one array."""
        return np.concatenate([np.ravel(d[k]) for d in (self.p, self.one, self.two) for k in d])

    def take(self, flat: np.ndarray) -> None:
        for d in (self.p, self.one, self.two):
            for k, v in d.items():
                n = np.size(v)
                d[k], flat = flat[:n].reshape(np.shape(v)), flat[n:]

    def score(self, x: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
        return self.forward(x.astype(float), of, np.searchsorted(of, np.arange(rows)))["y"]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in pieces(offsets):
            x, of = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ends = np.searchsorted(of, np.arange(1, hi - lo + 1))
            flat = [x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(flat, pa.binary())], names=["label", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (docs, passages, sums, sums of squares) of a part of the bags."""
    docs, n, total = 0, 0, np.zeros((2, FEATURES))
    for batch in batches:
        for raw in batch.column(batch.schema.get_field_index("x")):
            x = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, FEATURES).astype(float)
            docs, n, total = docs + 1, n + len(x), total + [x.sum(0), (x * x).sum(0)]
    cols = [pa.array([docs], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["docs", "passages", "total"])


def _round(model: Model, done: int, planned: int):
    """Each group's parameters after a pass over its bags, from the model's; groups come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bags() -> Iterator[tuple[int, np.ndarray, float]]:
            for batch in batches:
                for group, label, raw in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("group", "label", "x")), strict=True):
                    yield group.as_py(), np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, FEATURES), float(label.as_py())

        for group, own in itertools.groupby(bags(), lambda b: b[0]):
            mine = copy.deepcopy(model)
            steps = mine.learn(((x, y) for _, x, y in own), 1 << 62, done, planned)
            cols = [pa.array([group], pa.int32()), pa.array([steps], pa.int64()), pa.array([mine.flat().tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["group", "steps", "flat"])

    return run


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Learn from at most `sample` labelled documents, chosen by a hash of the id; None without labels.

    df holds doc_id and text, labels doc_id and quality. Whole texts are learned from. Rows without an id are not.
    """
    small_batches(df.sparkSession, 200)
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    # First by a share of the ids, so that no task hands on more than a little over its part of the sample.
    scale, place = 1 << 30, F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    share = min(1.0, 1.5 * sample / max(1, known.count()))
    # Bounded by `sample`, so it is broadcast.
    chosen = known.filter(place < int(scale * share)).orderBy(place, "_id", "label").limit(sample)
    rows = df.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("label", "text")
    with scratch(df.sparkSession):
        bags = materialize(rows.mapInArrow(_features, "label int, x binary"), "bags")
        parts = bags.mapInArrow(_moments, "docs long, passages long, total binary").collect()
        docs, n = (sum(p[i] for p in parts) for i in (0, 1))
        if not docs:
            return None
        sums, squares = sum((np.frombuffer(p.total).reshape(2, -1) for p in sorted(parts, key=lambda p: bytes(p.total))), np.zeros((2, FEATURES)))
        mean = sums / n
        spread = np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-3
        model = Model(mean, np.where(np.arange(FEATURES) < LOOKS, spread, FAINT * spread))
        order = F.xxhash64("x", "label")
        dealt = bags.withColumns({"group": F.pmod(F.shiftright(order, 32), F.lit(GROUPS)).cast("int"), "at": order})
        # Sorted by content, so that what is learned doesn't depend on how rows were dealt.
        dealt = dealt.repartition(GROUPS, "group").sortWithinPartitions("group", "at", "label")
        dealt = dealt.select("group", "label", "x")
        most = dealt.groupBy("group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        planned, done = rounds * -(-most // BATCH), 0
        for _ in range(rounds):
            found = sorted(dealt.mapInArrow(_round(model, done, planned), "group int, steps long, flat binary").collect(), key=lambda r: r.group)
            weight = np.array([r.steps for r in found], float)
            model.take(np.average([np.frombuffer(r.flat) for r in found], axis=0, weights=weight))
            model.steps += int(weight.max())
            done += int(weight.max())
    return model


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            y = np.full(batch.num_rows, 0.5)
            for lo, hi in pieces(offsets) if model else ():
                x, of = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                y[lo:hi] = model.score(x, of, hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y)], names=["doc_id", "score"])

    return run


def score(df: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of df: doc_id, score from 0 to 1, higher for what label 1 marks.

    * null, empty or blank text: scored as one passage of zeros. No model: 0.5 for all.
    * null doc_id and repeated rows: rows of their own. Empty table: empty. Other columns are ignored.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_score(model), "doc_id long, score double")


def _keep(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.schema.get_field_index("text")
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(index)], names=["doc_id", "text"])
            for scored in _score(model)([plain]):
                yield batch.filter(pa.array(scored.column(1).to_numpy() >= threshold))

    return run


def accept(df: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores at least the threshold, all their columns as they were.

    No model: every row. A score equal to the threshold stays. Null and empty texts are scored as one passage of zeros;
    repeated rows stay or go together. Empty table: empty.
    """
    small_batches(df.sparkSession)
    return df if model is None else df.mapInArrow(_keep(model, threshold), df.schema)


def held_out(id_: Column | None = None) -> Column:
    return crc_mod(F.col("doc_id") if id_ is None else id_, FOLDS) == HELD


def score_all(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labels outside the held-out fold, score every row; adds held_out and predicted."""
    out = score(df, train(df, labels.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
