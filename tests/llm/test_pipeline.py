import hashlib

import corpus_pipeline as P
from causeway.llm import quality
from causeway.llm.jaccard import near_dedup


def test_stages_take_effect(spark, tmp_path):
    """Each stage on its predecessor's rows, against what its operator decides."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == P.COLUMNS
        if name == "exact dedup":
            texts = [hashlib.md5(" ".join(r["text"].split()).encode()).digest() for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert kept["packing"] == kept["suffix-array dedup"]
    assert len(kept["packing"]) < 200 and sorted(r["doc_id"] for r in P.run(spark, d).collect()) == sorted(kept["packing"])


def test_filters_keep_rows_as_they_are(spark, odd_docs, no_docs):
    model = quality.prior_model()
    for f in (lambda x: quality.keep_good(x, model), near_dedup):
        assert f(odd_docs).columns == odd_docs.columns and f(no_docs).collect() == []
    kept = sorted(r["doc_id"] for r in near_dedup(odd_docs).collect())
    assert kept == [1, 1, 3, 3, 4, 5, 7, 8, 9, 10]
    scored = {(r["doc_id"], r["predicted"]) for r in quality.score_quality(odd_docs, model).collect()}
    assert {r["doc_id"] for r in quality.keep_good(odd_docs, model).collect()} == {i for i, p in scored if p == 1}


def test_one_row_of_repeated_ones_reaches_the_end(spark, tmp_path):
    """Repeated rows whose texts are long enough for the suffix arrays, and rows that share an id."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    a, b, c, d = (text(x) for x in "abcd")
    rows = [(1, a), (1, a), (1, a.replace(" ", "  ")), (2, b), (3, b), (3, c), (4, d), (4, d + " end"), (None, a), (None, text("e")), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expected = sorted([(1, a), (2, b), (3, c), (4, d), (0, text("e"))])
    for name, stage in P.STAGES[1:]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        assert sorted(r["doc_id"] or 0 for r in got) == ([0, 1, 2, 3, 4, 4] if name == "exact dedup" else [0, 1, 2, 3, 4])
        if name in ("n-gram Jaccard join", "suffix-array dedup"):
            kept = {r["doc_id"] or 0: r["text"].split() for r in got}
            assert kept[4] in (d.split(), d.split() + ["end"])
            assert all(kept[i] == t.split() for i, t in expected if i != 4)
