import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import substring_dedup as sd
from causeway.llm.suffix_array import permuted_lcp, repeated_windows, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3).flatmap(lambda k: st.tuples(st.just(k), st.lists(st.integers(0, k), max_size=40))))
def test_suffix_array(case):
    top, s = case
    sa = suffix_array(s, top)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    text = "".join(map(chr, s))
    before, plcp = permuted_lcp(text, sa, 6)
    for i, j in enumerate(before):
        if j >= 0:
            k = 0
            while k < 6 and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert plcp[i] == k and sa[sa.index(i) - 1] == j


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.integers(1, 4))
def test_windows_of_pieces(pieces, w):
    every = Counter(p[i : i + w] for p in pieces for i in range(len(p) - w + 1))
    for p, hit in zip(pieces, repeated_windows([list(p) for p in pieces], w)):
        assert hit.tolist() == [every[p[i : i + w]] > 1 for i in range(len(p) - w + 1)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)))
def test_pieces_cover_all_windows(data):
    seen = [i for _, _, first, last in sd.pieces_of(data, 9, 3) for a, b in zip(first, last) for i in range(a, b + 1)]
    assert seen == list(range(max(0, len(data) - 8)))


def test_equal_windows_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 50)
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    anchor = {}
    for fp, _, first, last in sd.pieces_of(data, 12, 4):
        for f, a, b in zip(fp, first, last):
            for i in range(a, b + 1):
                assert anchor.setdefault(data[i : i + 12], f) == f


def brute(rows, w):
    data = [(d, (t or "").encode()) for d, t in rows]
    every = Counter(b[i : i + w] for _, b in data for i in range(len(b) - w + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - w + 1):
            if every[b[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if d is None else d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, w, **kw):
    rows = sd.substring_dedup(df, w, **kw).drop("spans").collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_small_windows(spark, hot):
    rng = random.Random(hot)
    parts = ["".join(rng.choice("abcé") for _ in range(12)) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts)[: rng.randint(3, 12)] for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(60, "xy" * 30), (61, None), (62, ""), (None, rows[3][1]), (3, rows[3][1]), (4, "q" + rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 14, gram=5, step=hot % 3 + 1, hot=hot) == brute(rows, 14)


def test_real_rows(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run(docs, 200) == brute([tuple(r) for r in docs.collect()], 200)
    assert run(no_docs, 200) == []
    assert run(odd_docs.filter("doc_id <> 5"), 20, gram=9, step=4) == brute([(r["doc_id"], r["text"]) for r in odd_docs.filter("doc_id <> 5").collect()], 20)


def test_kept_text(spark):
    text = "Ä" * 150 + "start"
    out = sd.substring_dedup(spark.createDataFrame([(1, text), (2, "end" + "Ä" * 150)], "doc_id long, text string"), with_text=True)
    assert sorted(r["kept_text"] for r in out.collect()) == ["end", "start"]


def test_without_repeats_keeps_columns(odd_docs, no_docs):
    out = sd.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and sd.without_repeats(no_docs).collect() == []
    # The two very long texts are equal and lose everything; all others are short.
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in odd_docs.collect() if r["doc_id"] not in (5, 6))
