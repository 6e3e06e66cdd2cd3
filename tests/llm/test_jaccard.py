import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import jaccard
from causeway.llm.components import components
from causeway.llm.count_tree import CountTree, count_vector, least_overlap, pack, pairs_across, pairs_among, unpack, vectors
from causeway.llm.jaccard import jaccard_components, pack_postings, prefix, unpack_postings
from causeway.llm.shingles import shingle_hashes, shingle_set


def brute(rows, size=5, percent=75):
    sets = [shingle_set(t or "", size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, j in {p for h in holders.values() for p in combinations(h, 2)}:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * len(sets[i] | sets[j]):
            group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((-1 if d is None else d, len(s), -1 if least[root(i)] is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(df, **kw):
    return sorted(tuple(-1 if v is None else v for v in r) for r in jaccard_components(df, **kw).collect())


TEXT = st.text(st.sampled_from("aB é\t\n\x0b\x1c"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_hashes_stand_for_the_sets(texts):
    found = list(shingle_hashes(texts))
    sets = [shingle_set(t) for t in texts]
    assert [len(h) for h in found] == [len(s) for s in sets]
    for i, j in combinations(range(len(texts)), 2):
        assert len(np.intersect1d(found[i], found[j])) == len(sets[i] & sets[j])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=30))
def test_postings_round_trip(rows):
    k, s = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    sizes = s % 1000
    assert all((a % 1000 == b).all() for _, a, b in [unpack_postings(pack_postings(k, s, sizes), True)])
    keys, sets = unpack_postings(pack_postings(k, s))
    assert sorted(zip(keys.tolist(), sets.tolist())) == sorted(rows) and keys.tolist() == sorted(keys.tolist())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60)))
def test_similar_sets_share_a_prefix(a, b, often):
    if 4 * len(a & b) < 3 * len(a | b):
        return
    frequent = np.array(sorted(often), np.uint64)
    rank = np.array([(x * 7) % 61 for x in sorted(often)])
    p, q = (prefix(np.array(sorted(s), np.uint64), frequent, rank, 75) for s in (a, b))
    assert np.intersect1d(p, q).size


def test_tree_finds_every_similar_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, size=rng.choice([5, 40, 90, 130, 300])).astype(np.uint64)) for _ in range(60)]
    for k in range(140):
        s = sets[k]
        drop = rng.random(len(s)) < rng.choice([0.02, 0.1, 0.3])
        sets.append(np.unique(np.concatenate([s[~drop], rng.integers(0, 2**63, size=int(drop.sum())).astype(np.uint64)])) if len(s) > 1 else s)
    packed, sizes = [count_vector(s) for s in sets], np.array([len(s) for s in sets])
    points = vectors(packed)
    assert (points.sum(axis=1) == sizes).all()
    true = set()
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert np.minimum(points[i], points[j]).sum() >= both
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            assert both >= least_overlap(sizes[i], sizes[j], 75)
            true.add((i, j))
    tree = CountTree(points, sizes)
    found = [tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, tree.pairs(tree, 75)))]
    assert len(found) == len(set(found)) and true <= set(found) and len(found) < 3000
    among = {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, pairs_among(packed, sizes, 75)))}
    assert true <= among <= set(found)
    one, two = CountTree(points[:100], sizes[:100]), CountTree(points[100:], sizes[100:])
    across = {(i, j + 100) for i, j in zip(*map(np.ndarray.tolist, one.pairs(two, 75)))}
    assert {(i, j) for i, j in true if i < 100 <= j} <= across
    labels = np.arange(len(sizes)) % 3
    apart = {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, pairs_across(packed, sizes, None, 75, labels)))}
    assert {(i, j) for i, j in true if labels[i] != labels[j]} <= apart and all(labels[i] != labels[j] for i, j in apart)
    between = set(zip(*map(np.ndarray.tolist, pairs_across(packed, sizes, 100, 75))))
    assert {(i, j) for i, j in true if i < 100 <= j} <= between and all(i < 100 <= j for i, j in between)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {5: 3, 4: 3, 3: 3, 9: 3, 10: 10, 11: 10, 12: 10} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited(rng, words, share):
    return [rng.choice("pqrstuvw") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("page", [3, 4096])
def test_near_copies(spark, monkeypatch, page):
    monkeypatch.setattr(jaccard, "PAGE", page)
    monkeypatch.setattr(jaccard, "VERIFIED", 4)
    monkeypatch.setattr(jaccard, "ASKED", page)
    monkeypatch.setattr(jaccard, "FREQUENT", 40)
    rng = random.Random(page)
    passage = [f"shared{i}" for i in range(30)]
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 150))]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))) for _ in range(rng.randint(1, 12))]
    chain = [f"c{i}" for i in range(120)]
    for i in range(0, 40, 3):  # each resembles the next one only
        rows.append(" ".join(chain[i : i + 60]))
    for _ in range(25):
        own = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 12))]
        rows.append(" ".join(own + passage))
    rows += ["t1 t2 t3 t4 t5 t6 t7", "t1 t2 t3 t4 t5 t6 t7 t8", "v1 v2 v3 v4 v5 v6", "v1 v2 v3 v4 v5 v6 v7"]  # 3 of 4, 2 of 3
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, " \n"), (None, rows[3]), (903, "one two"), (904, "ONE  Two"), (7, rows[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)


def test_real_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])
    assert run(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert run(no_docs) == []


def test_count_vectors_round_trip():
    for counts in ([0] * 256, [1, 0, 2, 7] * 64, [8] * 256, [300] * 256, [70_000] * 256):
        assert unpack(pack(np.array(counts))).tolist() == counts
    assert unpack(count_vector(np.zeros(0, np.uint64))).sum() == 0
