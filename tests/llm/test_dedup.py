import hashlib
import importlib
import json
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from quadrille.llm import common, exact_dedup, near_dedup, setsketch
from quadrille.llm.components import components

components_module = importlib.import_module("quadrille.llm.components")

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(FOLD)
        ids = [x for x in groups[norm] if x is not None]
        top = max(ids, default=None)
        out.append((i, top, len(groups[norm]), i == top, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_near(rows, percent=85):
    """component of each id, by all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("salts", [1, 64])
def test_exact(nasty, salts):
    got = Counter(tuple(r) for r in exact_dedup.classes(nasty, salts=salts).collect())
    assert got == brute_exact(pairs(nasty))


def test_exact_documents(documents, empty):
    got = Counter(tuple(r) for r in exact_dedup.classes(documents).collect())
    assert got == brute_exact(pairs(documents))
    assert exact_dedup.classes(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


#: One id with several texts, repeated rows, null ids alone and beside others, ties in case.
CLASHING = [
    (9, "x one", "a"), (9, "y", "a"), (10, "y", "b"), (10, "Y", "c"), (10, "Y", "c"), (None, "z", "q"), (None, "z", "r"), (None, "y", "s"),
    (3, None, "k"), (4, "", "k"), (5, "Z z", "k"), (5, "z Z", "k"), (5, "other", "k"), (None, None, "n"), (9, "x one", "a"),
]


def kept_exact(rows):
    """One row of each text: the largest (id, JSON), null ids first."""
    best = {}
    for r in rows:
        norm = (r[1] or "").translate(FOLD)
        pairs = [("doc_id", r[0]), ("text", r[1]), ("source", r[2])]
        text = json.dumps({k: v for k, v in pairs if v is not None}, separators=(",", ":"))
        key = (r[0] is not None, r[0] or 0, text)
        if norm not in best or key > best[norm][0]:
            best[norm] = (key, r)
    return Counter(r for _, r in best.values())


@pytest.mark.parametrize("width", [32, 1, 0])
def test_exact_by_row(spark, width):
    """width 0 and 1: all or many texts share a digest, and are told apart by their text."""
    rng = random.Random(width)
    rows = CLASHING + [(rng.choice([None, *range(40)]), rng.choice("abcdefABC") * rng.randrange(3), rng.choice("st")) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert as_rows(exact_dedup.deduplicate(df, width=width)) == kept_exact(rows)
    got = Counter(tuple(r)[:4] for r in exact_dedup.classes(df, width=width).collect())
    assert got == sum((Counter({k[:4]: n}) for k, n in brute_exact([r[:2] for r in rows]).items()), Counter())
    left = exact_dedup.deduplicate(df, width=width)
    assert {(t or "").translate(FOLD) for _, t, _ in rows} == {(r.text or "").translate(FOLD) for r in left.collect()}


def test_exact_rows_stay_whole(nasty):
    kept = exact_dedup.deduplicate(nasty)
    assert kept.columns == nasty.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({2: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1, 10: 1, 11: 1})


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_against_all_pairs(spark):
    """Families of edited copies around the threshold, shared passages, and exact copies."""
    rng, rows, i = random.Random(3), [], 0
    passage = [f"p{j}" for j in range(60)]
    for family in range(12):
        base = [f"f{family}w{j}" for j in range(rng.choice([6, 30, 150]))]
        for _ in range(12):
            rows.append((i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 6]))))
            i += 1
    for _ in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([5, 10, 40]))]
        rows.append((i, " ".join(passage + own)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "one"), (i + 3, "ONE"), (i + 4, "one two")]
    want = brute_near(rows)
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert len({c for _, c in want.values()}) > 60


def test_near_edge_cases(nasty, empty):
    out = near_dedup.classes(nasty).collect()
    assert len(out) == nasty.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == 1
    assert by[7].component_id == by[8].component_id == 7
    assert by[3].n_shingles == 0 and by[3].kept and by[4].kept and by[5].kept
    assert [r.component_id for r in out if r.doc_id is None] == [None, None]
    assert near_dedup.classes(empty).count() == 0
    kept = near_dedup.deduplicate(nasty)
    assert kept.columns == nasty.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 9, 10, 11, None}


def test_near_documents(documents):
    rows = pairs(documents)
    out = near_dedup.classes(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_near(rows)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[1000:]
    one = lambda h: setsketch.registers(h, np.zeros(len(h), np.int64), 1)[0]
    assert (setsketch.merge(one(a), one(b)) == one(x)).all()
    assert (one(a) == one(a[::-1])).all()
    est = setsketch.joint_estimate(one(a)[None], one(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 1 / 3) < 0.12
    # Alone or beside other rows, and however few elements, a set has the same registers.
    rows = np.repeat([0, 1, 2], [2000, 1, 3])
    both = setsketch.registers(np.concatenate([a, a[:1], a[:3]]), rows, 4)
    assert (both[0] == one(a)).all() and (both[1] == one(a[:1])).all() and (both[2] == one(a[:3])).all()
    assert (both[3] == 0).all()


def test_unequal_bits_bound():
    assert near_dedup.most_unequal(100) == 0
    assert 30 < near_dedup.most_unequal(85) < 50


def brute_near_rows(rows, percent=85):
    """Per row (shingles, smallest id of its class), each row a node of its own."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                of[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        at = find(i)
        if r[0] is not None:
            least[at] = r[0] if least[at] is None else min(least[at], r[0])
    return [(len(sets[i]), r[0] if not sets[i] else least[find(i)], find(i)) for i, r in enumerate(rows)]


def test_near_by_row(spark):
    """One id with several texts, null ids, repeated rows: no text is lost and no class stays twice."""
    rng = random.Random(11)
    rows = list(CLASHING) + [(5, "b " * 30 + "c", "s"), (9, "a text of nine that none else has got", "s"), (9, "b " * 30 + "c", "s"), (None, "b " * 30 + "C", "s")]
    for family in range(8):
        base = [f"f{family}w{j}" for j in range(rng.choice([6, 40, 120]))]
        rows += [(rng.choice([None, *range(20)]), edited(rng, base, rng.choice([0, 0, 1, 2])), "t") for _ in range(8)]
    rows += [rows[-1], rows[-1], (None, "alone without an id at all", "t"), (None, "alone without an id AT all", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = brute_near_rows(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.classes(df).collect())
    assert got == Counter((r[0], n, c) for r, (n, c, _) in zip(rows, want, strict=True))
    kept = [tuple(r) for r in near_dedup.deduplicate(df).collect()]
    at = {r: (n, c, node) for r, (n, c, node) in zip(rows, want, strict=True)}
    assert Counter(at[r][2] for r in kept if at[r][0]) == Counter({node: 1 for n, _, node in want if n})
    assert all(r[0] == at[r][1] for r in kept if at[r][0])
    assert Counter(r for r in kept if not at[r][0]) == Counter(r for r in rows if not at[r][0])


def test_near_large_bucket(spark, monkeypatch):
    """Buckets dealt over several parts, and several pivots a round, find the same classes."""
    monkeypatch.setattr(near_dedup, "SPLIT", 7)
    monkeypatch.setattr(near_dedup, "PIVOTS", (1, 3, 8))
    rng, passage = random.Random(12), [f"p{j}" for j in range(80)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 12, 20]))])) for i in range(70)]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_near(rows)


def test_scratch_tables_go(spark, documents):
    """What operators write for themselves is deleted, and what a lazy result reads goes with `clear`."""
    from urllib.parse import urlsplit

    common.clear(spark)
    folder = Path(urlsplit(common.shared_dir(spark)).path)
    before = set(folder.iterdir())
    out = near_dedup.classes(documents)
    out.count()
    assert len(set(folder.iterdir()) - before) == 2
    common.clear(spark)
    assert set(folder.iterdir()) <= before


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 180)] + [(7, 7)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [-1, components_module.FEW])
def test_components_here_and_there(spark, monkeypatch, few):
    """On the driver and on the executors: long chains in any order, negative and large ids, loops, nulls, repeats."""
    monkeypatch.setattr(components_module, "FEW", few)
    chain = [(i * 7 % 301 - 5, (i + 1) * 7 % 301 - 5) for i in range(200)]
    links = [*chain, *chain[:9], (2**62, -(2**62)), (2**62, 2**61), (1000, 1000), (None, 3), (4, None)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {x: min(y for e in chain for y in e) for e in chain for x in e} | {x: -(2**62) for x in (2**62, 2**61, -(2**62))}
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_near_copies_pairs(spark, monkeypatch):
    """A bucket of many copies that link only in part: classes close before many pivots meet them, so pairs stay few."""
    rng = random.Random(3)
    base, rows, seen = [f"w{rng.randrange(10**6)}" for _ in range(120)], [], []
    for i in range(300):
        text = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3])):
            text[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    real = near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)
    assert sum(seen[1:]) < 600, seen
