"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte goes that a string of ``window`` bytes covers which also starts
anywhere else, in the same document or another.

Suffix arrays are built in shards, so equal windows must meet in one shard:

1. In each window the smallest hash of a 64-byte string in it (the leftmost of
   equals) is its anchor.  Equal windows have equal anchors at the same place
   in them.  Neighbouring windows share anchors, so there is one for about 70
   bytes.  An anchor with the windows that it stands for is a piece: the bytes
   that those windows cover.  Pieces are hashed too.
2. Pieces whose anchor occurs once can't repeat and go.
3. Where the same piece occurs twice, all its windows repeat.
4. Among different pieces with one anchor, only parts may repeat.  One copy of
   each such piece is cut into slices of up to ``STEP`` windows, by their
   distance from the anchor.  All windows of a slice share a core of
   ``window - STEP + 1`` bytes, whose hash is the slice's key, and steps 2 and
   3 are done for slices.
5. Among different slices with one core, one copy of each is put into a shard
   by its core.  In a shard each distinct core, compared byte by byte, is one
   symbol, so a slice is a few bytes, its core's symbol and a few bytes.  Shard
   arrays are induced from the concatenated slices, and windows whose permuted
   common prefix with a neighbour in the array is a whole window repeat.
6. A core that stands in more than ``HOT`` different slices would fill a shard.
   Its slices' windows are counted one by one by their 128-bit hashes instead,
   which Spark combines before the shuffle.

The results are exact up to collisions: an (anchor, piece) pair of 64-bit
hashes in steps 3 and 4, a 128-bit hash in step 6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, materialise, shuffle_partitions, text_of, tidy
from .suffix_array import repeated_windows

WINDOW, GRAM = 200, 64
STEP, HOT = 16, 32
#: Places of a text handled at once.
BLOCK = 1 << 17
#: Slices in one suffix array.
SHARD_SLICES = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` bytes."""
    n = len(data)
    up, down = _base_powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its smallest (leftmost) one.
    The upper 44 bits are compared, the place decides between equals."""
    n = len(h)
    places = n - width + 1
    size = -(-n // width) * width
    key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:places], ahead[width - 1 : width - 1 + places]) & np.uint64(0xFFFFF)).astype(np.int64)


def pieces_of(data: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hashes and places, first and last window starts of the pieces, by blocks."""
    raw = np.frombuffer(data, np.uint8)
    places = len(raw) - window + 1
    for a in range(0, places, BLOCK):
        b = min(a + BLOCK, places)
        h = gram_hashes(raw[a : b + window - 1], gram)
        at = leftmost_minima(h, window - gram + 1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], b - a) - 1
        yield h[at[first]].view(np.int64), at[first] + a, first + a, last + a


def _scan(window: int, gram: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, version, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "version", "text")]):
                data = text.encode()
                view = memoryview(data)
                for fp, anchor, first, last in pieces_of(data, window, gram):
                    hashes = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + window).tolist())]
                    cols[0].append(fp)
                    cols[1].append(np.array(hashes, np.uint64).view(np.int64))
                    cols[2].append(np.full(len(fp), doc, np.int64))
                    cols[3].append(np.full(len(fp), version, np.int64))
                    cols[4].append(first << 16 | (last - first) << 8 | anchor - first)
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "piece", "doc_id", "version", "at"])

    return run


def unpack(at: int) -> tuple[int, int, int]:
    """First and last window start and the anchor's place."""
    first = at >> 16
    return first, first + (at >> 8 & 0xFF), first + (at & 0xFF)


def _cut_pieces(window: int):
    """Bytes of the pieces asked for."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, version, text, asked in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "asked")]):
                data = text.encode()
                for x in asked:
                    first, last, _ = unpack(x["at"])
                    for c, v in zip(cols, (doc, version, x["at"], x["known"], data[first : last + window])):
                        c.append(v)
            kinds = [pa.int64()] * 3 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "version", "at", "known", "bytes"])

    return run


def slices_of(at: int, window: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, first and last window start, start of the core) of a piece's slices."""
    first, last, anchor = unpack(at)
    for k in range((anchor - last) // step, (anchor - first) // step + 1):
        core = anchor - step * k
        yield k, max(first, core - step + 1), min(last, core), core


def _slice(window: int, step: int):
    core_bytes = window - step + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pieces, rows, firsts, lasts, cores = [], [], [], [], [], []
            for i, (at, data) in enumerate(zip(batch.column("at").to_pylist(), batch.column("bytes").to_pylist())):
                base, view = at >> 16, memoryview(data)
                for k, a, b, core in slices_of(at, window, step):
                    keys.append(xxhash.xxh3_64_intdigest(view[core - base : core - base + core_bytes], k))
                    pieces.append(xxhash.xxh3_64_intdigest(view[a - base : b - base + window], core - a))
                    rows.append(i)
                    firsts.append(a)
                    lasts.append(b)
                    cores.append(core)
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "version", "at", "known")]
            yield pa.RecordBatch.from_arrays([signed(keys), signed(pieces), *taken, *[pa.array(c, pa.int64()) for c in (firsts, lasts, cores)]], ["key", "piece", "doc_id", "version", "at", "known", "first", "last", "core"])

    return run


def _cut_slices(window: int):
    """Bytes of the slices asked for."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc, version, at, data, asked in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "version", "at", "bytes", "asked")]):
                base = at >> 16
                for x in asked:
                    for c, v in zip(cols, (x["key"], doc, version, x["first"], x["core"] - x["first"], x["known"], data[x["first"] - base : x["last"] - base + window])):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "doc_id", "version", "first", "core", "known", "bytes"])

    return run


def _hash_windows(window: int):
    """128-bit hashes of the windows of the slices asked for."""
    cut = _cut_slices(window)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            rows, starts, digests = [], [], []
            for i, (first, data) in enumerate(zip(batch.column("first").to_pylist(), batch.column("bytes").to_pylist())):
                view, places = memoryview(data), range(len(data) - window + 1)
                digests += [xxhash.xxh3_128_digest(view[k : k + window]) for k in places]
                starts += [first + k for k in places]
                rows += [i] * len(places)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "version", "known")]
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *taken, pa.array(starts, pa.int64())], ["w1", "w2", "doc_id", "version", "known", "start"])

    return run


def _shard_arrays(window: int, step: int):
    """Repeated windows of slices that come sorted by core."""
    core_bytes = window - step + 1

    def flush(held: list[tuple]) -> pa.RecordBatch:
        symbols: dict[bytes, int] = {}
        strings = []
        for *_, core, _, data in held:
            middle = data[core : core + core_bytes]
            strings.append([*data[:core], symbols.setdefault(middle, 256 + len(symbols)), *data[core + core_bytes :]])
        docs, versions, firsts, lasts = [], [], [], []
        for (_, doc, version, start, _, known, _), hit in zip(held, repeated_windows(strings, step)):
            if known or not hit.any():
                continue
            edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
                docs.append(doc)
                versions.append(version)
                firsts.append(start + int(a))
                lasts.append(start + int(b) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, versions, firsts, lasts)], ["doc_id", "version", "first", "last"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held) >= SHARD_SLICES and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def covered(ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Byte ranges (end exclusive) that windows starting in ``ranges`` (both ends
    inclusive) cover, merged."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _remove(window: int, with_text: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                data = text.encode()
                spans = covered([(r["first"], r["last"]) for r in ranges or []], window)
                kept = cut(data, spans)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [list(x) for x in spans], kept.decode("utf-8", "ignore") if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)][: 6 if with_text else 5]
            passed = [n for n in ("doc_id", "carried") if n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in passed], *arrays], [*passed, *names[: len(arrays)]])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, step: int = STEP, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row and,
    if asked for, ``kept_text`` and the row itself as ``carried``; ``spans`` are the
    removed byte ranges.

    A text is its UTF-8 bytes, a null one is empty; a text shorter than
    ``window`` stays whole.  ``kept_text`` leaves out characters of which only a
    part is left.  Rows that repeat id and text are documents of their own, so
    they lose each other's strings; so do rows that repeat an id with another
    text.  A null id is an id like any other.  An empty table gives no rows;
    further columns are ignored.
    """
    if not (0 < gram < window and window - gram < 256 and 0 < step < gram):
        raise ValueError("0 < step < gram < window and window - gram < 256 are needed")
    spark = docs.sparkSession
    arrow_batches(spark)
    null = F.lit(-(2**63))
    own = [F.coalesce(F.col(id_col).cast("long"), null).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("version"), text_of(text_col).alias("text")]
    texts = docs.select(*own)
    where = "doc_id long, version long"
    bounds = ["doc_id", "version", "first", "last"]

    def repeats(rows: DataFrame, name: str, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of rows with ``key`` and ``piece``: those whose piece occurs twice, and a
        copy of each piece that shares its key with others, in few and in many.

        Both sides of each join are read from the shared folder, so that adaptive
        execution can split a hot key."""
        several = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), f"{name}-keys")
        found = materialise(rows.join(several, "key"), f"{name}-found")
        counted = found.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "version", *columns)).alias("copy"))
        counted = materialise(counted, f"{name}-counted")
        twice = found.join(counted.filter("n > 1").select("key", "piece"), ["key", "piece"], "left_semi")
        kinds = materialise(counted.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), f"{name}-kinds")
        copies = counted.join(kinds, "key").select("key", "copy.*", (F.col("n") > 1).alias("known"), (F.col("kinds") > hot).alias("hot"))
        return twice, copies.filter("not hot"), copies.filter("hot")

    pieces = texts.mapInArrow(_scan(window, gram), f"key long, piece long, {where}, at long")
    whole, few, many = repeats(pieces, "pieces", "at")
    first = F.shiftright("at", 16)
    whole = whole.select("doc_id", "version", first.alias("first"), (first + F.shiftright("at", 8).bitwiseAND(0xFF)).alias("last"))

    asked = few.unionByName(many).groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "known")).alias("asked"))
    cut_out = texts.join(asked, ["doc_id", "version"]).mapInArrow(_cut_pieces(window), f"{where}, at long, known boolean, bytes binary")
    cut_out = materialise(cut_out, "piece-bytes")

    slices = cut_out.mapInArrow(_slice(window, step), f"key long, piece long, {where}, at long, known boolean, first long, last long, core long")
    again, few, many = repeats(slices.withColumnRenamed("known", "copy_known"), "slices", "at", "first", "last", "core", "copy_known")
    again = again.filter("not copy_known").select(*bounds)

    def with_bytes(copies: DataFrame) -> DataFrame:
        asked = copies.groupBy("doc_id", "version", "at").agg(F.collect_set(F.struct("key", "first", "last", "core", "known")).alias("asked"))
        return cut_out.drop("known").join(asked, ["doc_id", "version", "at"])

    # A slice of which there are copies has been marked; like one of a marked piece it is a witness only.
    witness = lambda copies: copies.select("key", *bounds, "core", "at", (F.col("known") | F.col("copy_known")).alias("known"))
    slice_schema = f"key long, {where}, first long, core long, known boolean, bytes binary"
    shards = with_bytes(witness(few)).mapInArrow(_cut_slices(window), slice_schema).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "doc_id", "version", "first")
    parts = shards.mapInArrow(_shard_arrays(window, step), f"{where}, first long, last long")

    windows = with_bytes(witness(many)).mapInArrow(_hash_windows(window), f"w1 long, w2 long, {where}, known boolean, start long")
    windows = materialise(windows, "hot-windows")
    equal = materialise(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"), "equal-windows")
    singles = windows.filter("not known").join(equal, ["w1", "w2"], "left_semi").select("doc_id", "version", F.col("start").alias("first"), F.col("start").alias("last"))

    marks = whole.unionByName(again).unionByName(parts).unionByName(singles)
    marks = marks.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"), *own) if carry else texts
    out = rows.join(marks, ["doc_id", "version"], "left").select(*(["carried"] if carry else []), "doc_id", "text", "ranges")
    schema = T.StructType([f for f in out.schema if f.name in ("doc_id", "carried")][::-1])
    for field in T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + (", kept_text string" if with_text else "")):
        schema = schema.add(field)
    out = out.mapInArrow(_remove(window, with_text), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != null, F.col("doc_id")))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the text that :func:`substring_dedup` leaves and, where there is
    such a column, its length in ``chars_col``.  Documents that lose all their
    text go; those that were empty before stay."""
    found = substring_dedup(docs, window, id_col=id_col, text_col=text_col, with_text=True, carry=True)
    left = found.filter("n_removed = 0 or n_removed < n_bytes")
    changed, out = F.col("n_removed") > 0, []
    for c in docs.columns:
        own = F.col(f"carried.`{c}`")
        if c == text_col:
            own = F.when(changed, F.col("kept_text")).otherwise(own)
        elif c == chars_col:
            own = F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return left.select(*out)
