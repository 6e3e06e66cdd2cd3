import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from causeway.llm.common import scratch
from causeway.llm.sentencepiece_bpe import AgendaEncoder, sentencepiece_encode
from causeway.llm.token_output import read_token_shards, shuffle_planes, together, unshuffle_planes, write_token_shards
from causeway.llm.vocab_encode import ByteLevelEncoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from([1, 8]), st.integers(1, 70))
def test_planes_round_trip(ids, unit, block):
    assert unshuffle_planes(shuffle_planes(np.array(ids, dtype="<u4"), block, unit)).tolist() == ids


def test_planes_refuse_other_bytes():
    with pytest.raises(ValueError):
        unshuffle_planes(b"x" * 40)


TEXT = st.text(st.sampled_from("ab .,\n\t'sé日▁<|endoftext|> "), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_cached_encoders_equal_the_libraries(texts):
    ours = BYTES.encode_batch(texts)
    for t, ids in zip(texts, ours):
        assert np.frombuffer(ids, "<u4").tolist() == BYTES.library.encode(t, add_special_tokens=False).ids
    for t, (ids, text) in zip(texts, PIECES.encode_batch(texts)):
        assert ids == PIECES.library.encode(t) and text == " ".join(map(str, ids))


BYTES, PIECES = ByteLevelEncoder(BYTE), AgendaEncoder(PIECE, check_every=1)


class Counting:
    """The library, and how many texts and characters it was given."""

    def __init__(self, library):
        self.library, self.texts, self.chars = library, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.texts, self.chars = self.texts + len(texts), self.chars + sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **options)


def test_the_library_gets_each_stem_once_and_many_at_a_time():
    fresh = ByteLevelEncoder(BYTE)
    fresh.library = library = Counting(fresh.library)
    stems = [f"stem{'abcdefghij'[i // 100]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzäöüé'[i % 10]}" for i in range(1000)]
    text = " ".join(["First", *(s + end for end in ("", ".", ",", "!!", "$$$", ".\nThen") for s in stems)])
    assert np.frombuffer(fresh.encode_batch([text])[0], "<u4").tolist() == library.library.encode(text, add_special_tokens=False).ids
    assert library.texts < 50 and library.chars < 1.2 * sum(len(s) + 1 for s in stems)


ODD_PARTS = ["a", "The", "word", "é", "日", "'s", "'", "×", " ", " ", " ", "\n", "\n", ".", ",", "$$$", "....", "12", "_", "<|endoftext|>", "<|", "\t", "\r\n", "\x00", "\u2009", "\xa0", "\u200b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD_PARTS), max_size=25).map("".join), max_size=8))
def test_small_slices_blocks_and_caches(texts):
    expected = [SMALL.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in SMALL.encode_batch(texts)] == expected


SMALL = ByteLevelEncoder(BYTE)
SMALL.LIMIT, SMALL.SLICE, SMALL.BLOCK = 40, 30, 3


def test_parts_without_ids_are_forgotten(monkeypatch):
    fresh = ByteLevelEncoder(BYTE)
    with monkeypatch.context() as m, pytest.raises(MemoryError):
        m.setattr(fresh, "_joined", lambda parts: (_ for _ in ()).throw(MemoryError()))
        fresh.encode_batch(["one two three"])
    assert np.frombuffer(fresh.encode_batch(["one two three"])[0], "<u4").tolist() == fresh.library.encode("one two three", add_special_tokens=False).ids


def test_batches_are_put_together_up_to_a_size():
    batches = [pa.record_batch({"text": ["x" * n]}) for n in (10, 10, 500, 10, 10, 10)]
    put = list(together(iter(batches), 100))
    assert [b.num_rows for b in put] == [2, 1, 3] and pa.Table.from_batches(put) == pa.Table.from_batches(batches)


def test_parts_too_long_for_short_places(monkeypatch):
    monkeypatch.setattr(AgendaEncoder, "PLACE_BITS", 2)
    fresh = AgendaEncoder(PIECE, check_every=1)
    for text in ("international", "x" * 50, "日本語日本語", "a-b-c--d"):
        assert fresh.encode_batch([text])[0][0] == fresh.library.encode(text)


def expected_starts(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(BYTE), 0, []
    for doc, text in sorted((d, x or "") for d, x in rows):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return sorted(out)


@pytest.mark.parametrize("which", ["odd", "real", "none"])
def test_shards(spark, sf_dir, odd_docs, no_docs, which):
    docs = {"odd": odd_docs, "none": no_docs}.get(which) or spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "t")
    write_token_shards(docs, path, BYTE, chunk_ids=1000, block_ids=64)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in read_token_shards(spark, path).collect()) == expected_starts(rows)


@pytest.mark.parametrize("which", ["odd", "real", "none"])
def test_sentencepiece(spark, sf_dir, odd_docs, no_docs, which):
    docs = {"odd": odd_docs, "none": no_docs}.get(which) or spark.read.parquet(f"{sf_dir}/documents.parquet")
    lib, sha, expected = PIECES.library, lambda s: hashlib.sha256(s.encode()).hexdigest(), []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "") + [lib.eos_id()]
        expected.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert sorted(tuple(r) for r in sentencepiece_encode(docs, PIECE).collect()) == sorted(expected)
