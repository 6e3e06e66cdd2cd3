"""Closed forms against the definitions: paths are enumerated in plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from causeway.operators import identify as I
from causeway.operators.dsep import d_separated
from causeway.operators.paths import backdoor_paths, blocked, directed_paths


class Graph:
    def __init__(self, n, edges):
        self.n, self.edges = n, set(edges)
        self.v = range(1, n + 1)

    def pa(self, x):
        return {a for a, b in self.edges if b == x}

    def de(self, x, without=()):
        seen, stack = set(), [x]
        while stack:
            a = stack.pop()
            for s, d in self.edges:
                if s == a and d not in seen and d not in without:
                    seen.add(d)
                    stack.append(d)
        return seen

    def an(self, x):
        return {v for v in self.v if x in self.de(v)}

    def paths(self, s, t, directed=False):
        out, stack = [], [[s]]
        while stack:
            p = stack.pop()
            if p[-1] == t:
                out.append(p)
                continue
            for b in self.v:
                if b not in p and ((p[-1], b) in self.edges or (not directed and (b, p[-1]) in self.edges)):
                    stack.append(p + [b])
        return out

    def backdoor(self, x, y, mode):
        out = [[x] + p for q in self.pa(x) for p in self.paths(q, y)]
        return out if mode == "reference" else [p for p in out if x not in p[1:]]

    def directed(self, x, y, mode):
        return self.paths(x, y, directed=mode == "pearl")

    def blocked(self, p, z):
        for a, b, c in zip(p, p[1:], p[2:]):
            if (a, b) in self.edges and (c, b) in self.edges:
                if b not in z and not self.de(b) & z:
                    return True
            elif b in z:
                return True
        return len(p) < 2

    def dsep(self, xs, ys, z):
        return all(self.blocked(p, z) for x in xs for y in ys if x != y for p in self.paths(x, y))

    def valid(self, x, y, z, mode):
        return not z & ({x, y} | self.de(x)) and all(self.blocked(p, z) for p in self.backdoor(x, y, mode))

    def adjustment(self, x, y, mode):
        free = [v for v in self.v if v not in {x, y} | self.de(x)]
        return [set(c) for k in range(6) for c in combinations(free, k) if self.valid(x, y, set(c), mode)]

    def backdoor_set(self, x, y, mode):
        found = self.backdoor(x, y, mode)
        if not found:
            return set()
        z = self.pa(x) - self.de(x)
        return z if mode == "reference" or self.valid(x, y, z, mode) else None

    def frontdoor(self, x, y, ms, mode):
        if any(not set(p) & ms and not self.blocked(p, ms) for p in self.directed(x, y, mode)):
            return False
        for m in ms:
            first = self.backdoor(x, m, mode)
            if first if mode == "reference" else any(not self.blocked(p, set()) for p in first):
                return False
            if any(not self.blocked(p, {x}) for p in self.backdoor(m, y, mode)):
                return False
        return True

    def mediators(self, x, y, mode):
        on = {v for p in self.directed(x, y, mode) for v in p} - {x, y}
        return {m for m in on if self.frontdoor(x, y, {m}, mode)}

    def instrument(self, z, x, y, mode):
        if mode == "pearl":
            return x in self.de(z) and all(x in p for p in self.directed(z, y, mode)) and not self.backdoor(z, y, mode)
        return bool(self.directed(z, x, mode)) and all(x in p for p in self.directed(z, y, mode)) and not self.backdoor(z, y, mode)


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(11)
    out = {}
    for k in range(8):
        n = rng.randint(3, 5)
        order = rng.sample(range(1, n + 1), n)
        pairs = [(order[i], order[j]) for i in range(n) for j in range(i + 1, n)]
        out[f"g{k}"] = Graph(n, [p for p in pairs if rng.random() < rng.choice([0.3, 0.6])])
    return out


@pytest.fixture(scope="module")
def tables(spark, graphs):
    e = spark.createDataFrame([(g, a, b) for g, x in graphs.items() for a, b in x.edges], "graph_id string, src long, dst long")
    v = spark.createDataFrame([(g, i) for g, x in graphs.items() for i in x.v], "graph_id string, node long")
    return e.cache(), v.cache()


def ask(spark, graphs, *extra):
    """Questions for every two nodes and, by ``extra(graph, x, y)``, further values."""
    rows, kinds = [], {"z": "array<long>", "m": "array<long>"}
    names = [n for n, _ in extra]
    for g, x in graphs.items():
        for a in x.v:
            for b in x.v:
                if a != b:
                    rows.append((f"{g}/{a}/{b}", g, a, b, *[f(x, a, b) for _, f in extra]))
    return rows, spark.createDataFrame(rows, "qid string, graph_id string, x long, y long" + "".join(f", {n} {kinds[n]}" for n in names))


def answers(df, value):
    return {r["qid"]: r[value] for r in df.collect()}


@pytest.mark.parametrize("mode", ["reference", "pearl"])
def test_adjustment(spark, graphs, tables, mode):
    rng = random.Random(1)
    rows, q = ask(spark, graphs, ("z", lambda g, a, b: sorted(rng.sample(list(g.v), rng.randint(0, 2)))))
    got = answers(I.valid_adjustment(*tables, q, mode), "valid")
    assert got == {r[0]: graphs[r[1]].valid(r[2], r[3], set(r[4]), mode) for r in rows}
    got = answers(I.backdoor_sets(*tables, q, mode), "members")
    want = {r[0]: graphs[r[1]].backdoor_set(r[2], r[3], mode) for r in rows}
    assert got == {k: None if v is None else sorted(v) for k, v in want.items()}
    got = {}
    for r in I.adjustment_sets(*tables, q, mode).collect():
        got.setdefault(r["qid"], []).append(r["members"])
    for r in rows:
        want = sorted(sorted(s) for s in graphs[r[1]].adjustment(r[2], r[3], mode))
        assert sorted(got.get(r[0], [])) == want
    got = answers(I.minimal_adjustment_set(*tables, q, mode), "members")
    for r in rows:
        want = sorted((len(s), sorted(s)) for s in graphs[r[1]].adjustment(r[2], r[3], mode))
        assert got[r[0]] == (want[0][1] if want else None)
    got = answers(I.backdoor_adjustable(*tables, q, mode), "adjustable")
    assert got == {r[0]: mode == "reference" or r[3] not in graphs[r[1]].pa(r[2]) for r in rows}


@pytest.mark.parametrize("mode", ["reference", "pearl"])
def test_frontdoor(spark, graphs, tables, mode):
    rng = random.Random(2)
    rows, q = ask(spark, graphs, ("m", lambda g, a, b: [rng.choice([v for v in g.v if v not in (a, b)])]))
    got = answers(I.frontdoor(*tables, q, mode), "frontdoor")
    assert got == {r[0]: graphs[r[1]].frontdoor(r[2], r[3], set(r[4]), mode) for r in rows}
    got = {}
    for r in I.frontdoor_mediators(*tables, q, mode).collect():
        got.setdefault(r["qid"], set()).add(r["node"])
    assert {r[0]: got.get(r[0], set()) for r in rows} == {r[0]: graphs[r[1]].mediators(r[2], r[3], mode) for r in rows}


@pytest.mark.parametrize("mode", ["reference", "pearl"])
def test_instruments(spark, graphs, tables, mode):
    rows = [(f"{g}/{z}/{a}/{b}", g, z, a, b) for g, x in graphs.items() for z in x.v for a in x.v for b in x.v if len({z, a, b}) == 3]
    q = spark.createDataFrame(rows, "qid string, graph_id string, z long, x long, y long")
    got = answers(I.valid_instrument(*tables, q, mode), "valid")
    assert got == {r[0]: graphs[r[1]].instrument(*r[2:], mode) for r in rows}
    rows, q = ask(spark, graphs)
    got = {}
    for r in I.instruments(*tables, q, mode).collect():
        got.setdefault(r["qid"], set()).add(r["node"])
    for r in rows:
        g = graphs[r[1]]
        assert got.get(r[0], set()) == {z for z in g.an(r[2]) if z != r[3] and g.instrument(z, r[2], r[3], mode)} | (got.get(r[0], set()) & {r[3]})


def test_d_separation(spark, graphs, tables):
    rng = random.Random(3)
    rows = []
    for g, x in graphs.items():
        for k in range(25):
            pick = lambda lo: sorted(rng.sample(list(x.v), rng.randint(lo, 2)))
            rows.append((f"{g}/{k}", g, pick(1), pick(1), pick(0)))
    q = spark.createDataFrame(rows, "qid string, graph_id string, x array<long>, y array<long>, z array<long>")
    got = answers(d_separated(tables[0], q), "separated")
    assert got == {r[0]: graphs[r[1]].dsep(r[2], r[3], set(r[4])) for r in rows}


@pytest.mark.parametrize("mode", ["reference", "pearl"])
def test_paths(spark, graphs, tables, mode):
    rows, q = ask(spark, graphs)
    for f, name in ((directed_paths, "directed"), (backdoor_paths, "backdoor")):
        got = {}
        for r in f(tables[0], q, mode).collect():
            got.setdefault(r["qid"], []).append(r["path"])
        for r in rows:
            assert sorted(got.get(r[0], [])) == sorted(getattr(graphs[r[1]], name)(r[2], r[3], mode))


def test_blocking(spark, graphs, tables):
    rng = random.Random(4)
    rows, z, active = [], [], []
    for g, x in graphs.items():
        for k, (a, b) in enumerate(combinations(x.v, 2)):
            s = set(rng.sample(list(x.v), rng.randint(0, 2)))
            for p in x.paths(a, b):
                rows.append((f"{g}/{k}", g, p, x.blocked(p, s)))
            z += [(f"{g}/{k}", v) for v in s]
            active += [(f"{g}/{k}", v) for v in x.v if v in s or x.de(v) & s]
    make = lambda r: spark.createDataFrame(r, "qid string, node long")
    paths = spark.createDataFrame(rows, "qid string, graph_id string, path array<long>, want boolean")
    out = blocked(tables[0], paths, make(z), make(active))
    assert out.count() == len(rows) and out.filter(F.col("blocked") != F.col("want")).isEmpty()
