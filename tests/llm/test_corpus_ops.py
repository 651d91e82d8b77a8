import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import bpe, chat_format, packing, quality, source_mix
from tests.llm.test_dedup import FOLD, brute_near_rows
from tests.llm.test_text_ops import plain_passages, plain_score

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeat=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if repeat * sizes[s] <= w[s] * level}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = repeat * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(df):
    rows = source_mix.mix(df).collect()
    texts = df.select("doc_id", "source", "text").collect()
    assert len(rows) == len(texts)
    sizes = defaultdict(int)
    for r in texts:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    assert abs(sum(taken.values()) - sum(want.values())) <= max(largest.values(), default=0)
    return rows


def test_mix(documents, nasty):
    rows = check_mix(documents)
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(documents.repartition(5)).collect()))
    check_mix(nasty)


def test_mix_edges(empty, nasty, documents):
    assert source_mix.mix(empty).count() == 0
    silent = source_mix.mix(nasty.filter("doc_id in (3, 4, 5)")).collect()
    assert [(r["size"], r.taken, r.target) for r in silent] == [(0, 0, 0.0)] * 3
    assert source_mix.mixed(empty).count() == 0
    out = source_mix.mixed(documents)
    assert out.columns == documents.columns
    copies = {r.doc_id: r.copies for r in source_mix.mix(documents).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}


def queued(rows, order, weights=(5, 2, 1), share=1.5, repeat=2):
    """How often each row (id, source, size) is taken, by a plain fair queue; `order` is each row's place in the shuffle."""
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    want, entries, seen = brute_targets(sizes), [], defaultdict(int)
    for n in sorted(range(len(rows)), key=lambda n: order[n]):
        i, source, size = rows[n]
        seen[source] += size
        entries += [((seen[source] + p * sizes[source]) / want[source], i, p, n) for p in range(repeat) if size]
    total, left, taken = 0, sum(want.values()), [0] * len(rows)
    for _, _, _, n in sorted(entries):
        if total + rows[n][2] / 2 > left:
            break
        total += rows[n][2]
        taken[n] += 1
    return taken


def test_mix_is_the_fair_queue(spark):
    """Against a plain queue over the same shuffled order, and whatever the number of buckets."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "b", "c", None]), rng.choice([0, 1, 5, 40])) for i in range(400)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    u = {r.doc_id: r.u % (1 << 64) for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.lit(None).cast("long"), "text").alias("u")).collect()}
    want = queued(rows, [u[i] for i, _, _ in rows])
    for bucket in (1 << 14, 2):
        got = {r.doc_id: r.copies for r in source_mix.mix(df, bucket=bucket).collect()}
        assert [got[i] for i, _, _ in rows] == want


def test_mixed_takes_what_mix_says(spark):
    """Repeated ids and rows, and rows without an id: each taken as often as said, and targets met."""
    rows = [(i % 7, f"s{i % 2}", "w " * (i % 5)) for i in range(60)] + [(None, "s0", "w w"), (None, "s0", "w w"), (None, None, "v")] * 6 + [(3, "s1", "x x x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).persist()
    check_mix(df)
    out = source_mix.mixed(df)
    said = defaultdict(int)
    for r in source_mix.mix(df).collect():
        said[r.doc_id, r.source, r["size"]] += r.copies
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert got == {k: n for k, n in said.items() if n}
    df.unpersist()


def check_packing(df, **kw):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = packing.pack(df, **kw).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(n for *_, n, _ in want) / 2048


def test_packing(documents, nasty, empty):
    n, least = check_packing(documents)
    assert n <= 1.02 * least + 1
    check_packing(documents, shard=64)
    check_packing(nasty)
    check_packing(documents, weigh_new=True)
    assert packing.pack(empty).count() == 0


def test_packing_special_strings(spark):
    """A special token's string is that token, as the library has it."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" * 70_000 + " y <|endoftext|><|endoftext|>z", "<|endoftext", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_packing(df)
    assert bpe.ids(texts[0], bpe.default_path()).tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("weigh_new", [False, True])
def test_place_minimises(weigh_new):
    """Every choice is one that a plain search over all open bins, and a new one, makes."""
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 41, 300))[::-1]
    bins, offsets = packing.place(lengths, 40, weigh_new)
    gaps = {}
    for b, o, s in zip(bins, offsets, lengths, strict=True):
        now = defaultdict(int)
        for g in gaps.values():
            now[g] += 1
        total = lambda c: sum(n * n for g, n in c.items() if g)

        def after(g):
            c = dict(now)
            if g is not None:
                c[g] -= 1
            rest = (40 if g is None else g) - s
            c[rest] = c.get(rest, 0) + 1
            return total(c)

        fits = sorted({g for g in gaps.values() if g >= s})
        choices = [after(g) for g in fits] + [after(None)] * (weigh_new or not fits)
        assert after(gaps.get(b)) == min(choices)
        assert (b in gaps) or weigh_new or not fits
        gaps[b] = gaps.get(b, 40) - s
        assert o == 40 - gaps[b] - s


def test_bpe_equals_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(9)
    parts = ["a", "Ab", "'s", " ", "  ", "\n", "\t", "é", "ß", "12", "%%", "日本", "😀", "\x1c", "\x85", "<|endoftext|>", "ing", "\r\n"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        for size in (1 << 16, 5):
            monkeypatch.setattr(bpe, "SLICE", size)
            assert bpe.ids(text, bpe.default_path()).tolist() == t.encode(text, add_special_tokens=False).ids


def turns_digest(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


def test_chat(spark):
    chats = {
        1: [("system", "be <b>"), ("user", "hi ### Assistant: </turn>"), ("assistant", "\\h \\\\ # < : \\s\n")],
        2: [("user", None), ("assistant", "")],
        3: [("assistant", "first")],
        4: [("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d")],
        5: [("tool: x", "é\n日本"), (None, "no role"), ("Assistant", "capital"), ("=odd", "y")],
        6: [("user", "x" * 50_000), ("assistant", "y" * 50_000)],
    }
    rows = [(c, i, r, t, 1) for c, ts in chats.items() for i, (r, t) in enumerate(ts)]
    rows += [(7, 0, "user", "same", 1)] * 2 + [(None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state int")
    made = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.digests(made).collect()}
    for c, ts in chats.items():
        said = "".join(t or "" for r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == turns_digest([(r or "", t or "") for r, t in ts])
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c: got[c].valid for c in chats} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert got[7].n_turns == 2 and got[None].n_turns == 1
    for r in made.collect():
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count("</turn>") * 3 == len(r.segments)
        whole, under = r.formatted.encode(), [s.text.encode() for s in r.segments if s.loss]
        assert [whole[s.start : s.start + s.bytes] for s in r.loss_spans] == under
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_hard_case(spark, sf):
    rows = chat_format.with_hard_case(spark, spark.read.parquet(f"{sf}/conversations.parquet"))
    r = chat_format.digests(chat_format.format_chats(rows)).filter("conv_id = -7").first()
    assert r.turns_sha256 == turns_digest([("user", chat_format.HARD), ("assistant", chat_format.HARD)])
    assert r.loss_chars == len(chat_format.HARD) and r.valid


@pytest.fixture(scope="module")
def hard_corpus(spark, documents, nasty, tmp_path_factory):
    """A folder whose documents repeat ids with other texts, repeat rows, and lack ids, texts and sources."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    some = documents.filter("length(text) < 4000").orderBy("doc_id").limit(70)
    odd = nasty.filter("doc_id is null or (doc_id <> 7 and doc_id <> 8)").select(*documents.columns)
    again = some.limit(25)
    shifted = again.withColumn("doc_id", F.col("doc_id") + 5)
    upper = again.withColumns({"text": F.upper("text"), "doc_id": F.lit(9).cast("long")})
    bare = again.limit(6).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")})
    near = again.withColumns({"doc_id": F.col("doc_id") + 300, "text": F.concat("text", F.lit(" one more"))})
    for part in (odd, again.limit(9), shifted, upper, bare, near):
        some = some.unionByName(part)
    some.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def as_rows(rows):
    return Counter(tuple(r) for r in rows)


def test_pipeline_against_plain(spark, hard_corpus):
    """Every stage on what its predecessor kept, against plain loops; then the run as a whole."""
    docs = spark.read.parquet(f"{hard_corpus}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{hard_corpus}/labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, hard_corpus).persist()
        assert out.columns == columns
        after = out.collect()
        if name == "quality":
            scores = {(r.doc_id, r.text): plain_score(model, plain_passages(r.text)) for r in before}
            assert as_rows(after) == as_rows(r for r in before if scores[r.doc_id, r.text] >= quality.THRESHOLD)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[(r.text or "").translate(FOLD)].append(r)
            assert len(after) == len(groups)
            for r in after:
                ids = [x.doc_id for x in groups[(r.text or "").translate(FOLD)] if x.doc_id is not None]
                assert r in groups[(r.text or "").translate(FOLD)] and r.doc_id == max(ids, default=None)
        elif name == "near_dedup":
            want = brute_near_rows([(r.doc_id, r.text) for r in before])
            at = {tuple(r): w for r, w in zip(before, want, strict=True)}
            assert Counter(at[tuple(r)][2] for r in after if at[tuple(r)][0]) == Counter({node: 1 for n, _, node in want if n})
            assert all(r.doc_id == at[tuple(r)][1] for r in after if at[tuple(r)][0])
            assert as_rows(r for r in after if not at[tuple(r)][0]) == as_rows(r for r in before if not at[tuple(r)][0])
        else:
            sizes = defaultdict(int)
            count = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            for r in before:
                sizes[r.source] += count(r)
            aims, times = brute_targets(sizes), as_rows(after)
            assert set(times) <= set(map(tuple, before)) and all(n <= 2 * as_rows(before)[r] for r, n in times.items())
            for s in sizes:
                taken, most = sum(count(r) for r in after if r.source == s), max(count(r) for r in before if r.source == s)
                assert abs(taken - aims[s]) <= 2 * most
        kept[name] = len(after)
        assert 0 < len(after) and (name == "source_mix" or len(after) < len(before))
        docs = out
    check_packing(docs)
    whole = corpus_pipeline.run(spark, hard_corpus)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, hard_corpus)
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(whole) == key(packed)


def test_pipeline_stages(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "source_mix", "packing"]
    docs, counts = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns
        assert out.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0
        docs = out.cache()
        counts.append(docs.count())
    assert counts[0] < documents.count() and counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] > counts[2]
    texts = docs.select(F.md5(F.lower("text")).alias("t"), "doc_id").distinct()
    assert texts.groupBy("t").count().filter("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    again = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
