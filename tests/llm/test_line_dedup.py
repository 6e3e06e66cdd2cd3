import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm.line_dedup import cut_lines, extend, line_dedup, lines_of, winnow


def brute(rows, run):
    first, out = {}, []
    places = sorted((d, i) for d, t in rows for i in range(len(lines_of(t)) - run + 1))
    text = dict(rows)
    window = lambda d, i: tuple(x for _, x in lines_of(text[d])[i : i + run])
    for p in places:
        first.setdefault(window(*p), p)
    for d, t in rows:
        starts = [i for i in range(len(lines_of(t)) - run + 1) if first[window(d, i)] != (d, i)]
        kept, lines, runs = cut_lines(t, starts, run)
        out.append((d, len(lines_of(t)), lines, runs, kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.integers(1, 5))
def test_every_window_has_its_minimum(hashes, run):
    seen = {}
    for p, first, last in winnow(hashes, run):
        for i in range(first, last + 1):
            assert hashes[p] == min(hashes[i : i + run]) and i <= p < i + run
            seen[i] = p
    assert sorted(seen) == list(range(max(0, len(hashes) - run + 1)))


def test_planted_runs(spark):
    a, b = [f"line {i}" for i in range(9)], [f"other {i}" for i in range(9)]
    rows = [
        (1, "\n".join(a)),
        (2, "\n".join(b[:4] + a[2:6] + b[4:])),
        (3, "\n".join(["x", "  line  3", "", "line 4 ", "line 5", "y"])),
        (4, "\n".join(a[:2] + b[:2] + a[7:])),  # runs of two stay
        (5, "same\n" * 6),
        (6, ""),
        (7, "\n".join(a)),
    ]
    got = sorted(tuple(r) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 3)
    assert [r[2] for r in got] == [0, 4, 3, 0, 5, 0, 9]


def test_matches_grow_to_maximal_runs(spark):
    place = lambda doc, at: (doc, 0, at)
    found = [(4, 3, place(1, 0)), (2, 3, place(9, 5)), (5, 3, place(1, 1)), (6, 3, place(1, 3)), (7, 3, place(1, 3)), (20, 3, place(1, 16))]
    assert extend(found) == [(2, 3, place(9, 5)), (4, 6, place(1, 0)), (6, 3, place(1, 3)), (20, 3, place(1, 16))]
    a = [f"line {i}" for i in range(9)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["x", *a[2:8], "y", *a[:3]]))]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_copies=True).collect()}
    assert got[1]["copies"] == [] and [tuple(c) for c in got[2]["copies"]] == [(1, 6, 1, 2), (8, 3, 1, 0)]


def test_query_and_its_sql(spark, sf_dir):
    import duckdb

    from causeway.llm import queries

    got = queries.QUERIES["op7_line_dedup"](spark, sf_dir)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op7_line_dedup"])
    assert sorted(want.columns) == names and sorted(want.project(", ".join(names)).fetchall()) == sorted(tuple(r) for r in got.select(*names).collect())
    assert any(r["n_removed"] for r in got.collect())


def test_real_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in line_dedup(docs).collect()) == brute(rows, 3)
    assert line_dedup(no_docs).collect() == []
    assert all(r["n_removed"] == 0 for r in line_dedup(odd_docs).collect())
    repeated = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "q")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept_text"]) for r in line_dedup(repeated).collect()) == [(0, "a\nb\nc"), (1, "d"), (1, "d"), (1, "q")]


def test_passages_of_fewer_lines(spark):
    """Runs of one and two lines count where they hold enough words, and only there."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    long, half, rest, short = words("a", 50), words("b", 25), words("c", 25), words("d", 49)
    rows = [
        (1, "\n".join([long, "x", half, rest, "y", short])),
        (2, "\n".join(["p", long.replace(" ", "  "), "q", short])),
        (3, "\n".join(["r", half, "", rest, "s"])),
        (4, "\n".join([half, "t", rest])),  # neither half is long enough
        (5, "\n".join([long, "u", long])),
        (6, "\n".join(["x", half, rest])),  # three lines
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup(docs, words=50).collect()}
    assert [got[i]["n_removed"] for i in range(1, 7)] == [0, 1, 2, 0, 2, 3]
    assert got[2]["kept_text"] == "\n".join(["p", "q", short]) and got[3]["kept_text"] == "r\n\ns" and got[5]["kept_text"] == "u"
    assert got[5]["n_runs"] == 2 and got[6]["kept_text"] == ""
    plain = sorted(tuple(r) for r in line_dedup(docs).collect())
    assert plain == brute(rows, 3) and [r[2] for r in plain] == [0, 0, 0, 0, 0, 3]
