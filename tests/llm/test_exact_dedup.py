import hashlib
import re

from pyspark.sql import functions as F

from causeway.llm.exact_dedup import exact_dedup, exact_groups


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (doc, _), n in zip(rows, norm):
        same = [d for (d, _), m in zip(rows, norm) if m == n]
        out.append((doc, min(same), len(same), doc == min(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(exact_groups(odd_docs)) == brute(rows)


def test_collisions_are_told_apart(odd_docs):
    weak = exact_groups(odd_docs, hash_of=lambda t: (F.length(t) % 2).cast("string").cast("binary"))
    assert rows_of(weak) == rows_of(exact_groups(odd_docs))


def test_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(exact_groups(docs)) == brute(rows)


def test_empty_table_and_dedup(no_docs, odd_docs):
    assert rows_of(exact_groups(no_docs)) == []
    kept = exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 3, 5, 7, 8, 9, 10]


def test_main_path_is_native(odd_docs):
    plan = exact_groups(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
