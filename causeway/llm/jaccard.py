"""N-gram Jaccard join with a count-vector R-tree.

Documents with equal shingle sets form a class; classes are joined.

1. One pass hashes shingles: each document's class, its set's size and count
   vector, and shingles that are frequent within a task.
2. Shingles are put into one order for all documents, frequent ones last.  Two
   sets that share 75 % of their union share a shingle among the first 25 % of
   each, so a second pass deals those to partitions, packed: keys are sorted
   and stored as differences.  Sets that share such a key and are of like
   sizes form a block; blocks with the same members count once.
3. The first set of a block is paired with its others; pairs whose count
   vectors bound the overlap high enough are verified on the texts' shingles.
   Links give components.
4. Blocks that hold several components are cut into pages of about ``PAGE``
   sets, a large component into pages of its own.  Pages of a block are joined
   with each other unless both hold one and the same component: each page is an
   R-tree over count vectors, and two trees are joined from their roots down.
   Of each two components that a join of pages finds one pair is verified,
   and what links merges.
5. Step 4 is repeated for the blocks in which a pair was found, now with all pairs
   between components that were not verified yet.  No pair is dropped, and
   pairs inside a component need no check, as they change nothing.

Pairs between components are few once components have grown, so a large group
of near copies does not cost the square of its size.  Results are exact up to
collisions of 64-bit shingle hashes within a pair of sets; verification itself
compares words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, keep_rows, materialise, shuffle_partitions, text_of, tidy
from .components import components
from .count_tree import count_vector, least_overlap, pairs_across, shared_at_most, unpack
from .shingles import WORDS, shingle_hashes, shingle_set

PERCENT = 75
#: Sets of a page, a part of a block that one task holds as a tree.
PAGE = 4096
#: Pairs with one set in common that a task verifies together.
VERIFIED = 256
#: Rows (of five numbers) asked for by a verification that are broadcast to the texts; more are joined by a shuffle.
ASKED = 50_000
#: Postings that a task turns into blocks.
POSTINGS = 2_000_000
#: Frequent shingles that the order knows: their number bounds what is broadcast.
FREQUENT = 262_144
#: A shingle is reported by a task when that many of its sets hold it.
LOCAL_FREQUENT = 3
#: Shingles of different sets that a task counts together.
COUNTED = 4_000_000


def _profile(size: int, seed: int):
    """Rows of documents (with key null) and of frequent shingles (with doc_id null)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        schema = ["doc_id", "version", "class", "check", "n", "vector", "key", "count"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def record(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema)

        def frequent() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = counts >= LOCAL_FREQUENT
            none = [None] * int(often.sum())
            return record([none] * 6 + [keys[often].view(np.int64), counts[often]])

        for batch in batches:
            found = list(shingle_hashes(batch.column("text").to_pylist(), size))
            cols: list[list] = [[], [], [], []]
            for h in found:
                raw = h.tobytes()
                cols[0].append(xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63))
                cols[1].append(xxhash.xxh3_64_intdigest(raw, seed + 1) - (1 << 63))
                cols[2].append(len(h))
                cols[3].append(count_vector(h))
            none = [None] * len(found)
            yield record([batch.column("doc_id"), batch.column("version"), *cols, none, none])
            for name, h in zip(cols[0], found):
                if name not in held:
                    held[name], total = h, total + len(h)
            if total >= COUNTED:
                yield frequent()
                held, total = {}, 0
        if held:
            yield frequent()

    return run


def pack_postings(keys: np.ndarray, sets: np.ndarray, sizes: np.ndarray | None = None) -> bytes:
    """Keys with their sets, in order of keys, as differences and places in a
    table of sets and their sizes, byte by byte so that Spark's compression finds equal ones."""
    order = np.argsort(keys, kind="stable")
    steps = np.diff(keys[order], prepend=np.uint64(0))
    known, first, places = np.unique(sets[order], return_index=True, return_inverse=True)
    own = (np.zeros(len(sets)) if sizes is None else sizes)[order][first].astype(np.uint32)
    planes = [steps.view(np.uint8).reshape(-1, 8).T[k].tobytes() for k in range(8)]
    places = places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    return b"".join([struct.pack("<II", len(keys), len(known)), known.tobytes(), *planes, *[places[k].tobytes() for k in range(4)], own.tobytes()])


def unpack_postings(data: bytes, with_sizes: bool = False) -> tuple[np.ndarray, ...]:
    n, m = struct.unpack_from("<II", data)
    known = np.frombuffer(data, np.int64, m, 8)
    planes = np.frombuffer(data, np.uint8, 12 * n, 8 + 8 * m).reshape(12, n)
    steps = np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel()
    places = np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel()
    out = np.cumsum(steps, dtype=np.uint64), known[places]
    return (*out, np.frombuffer(data, np.uint32, m, 8 + 8 * m + 12 * n)[places].astype(np.int64)) if with_sizes else out


def prefix(h: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which similar sets share one: the first in an order that
    has ``frequent`` shingles (ascending hashes with their ranks) last."""
    n = len(h)
    take = n - -(-percent * n // 100) + 1 if n else 0
    if not len(frequent):
        return h[:take]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    often = frequent[at] == h
    rare = h[~often]
    if len(rare) < take:
        common = h[often]
        rare = np.concatenate([rare, common[np.argsort(rank[at[often]], kind="stable")]])
    return rare[:take]


def _postings(size: int, seed: int, percent: int, parts: list[int], frequent: np.ndarray, rank: np.ndarray):
    names_of = np.array(parts, np.int64)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, sets, sizes, held
            # Short hashes come first in every set; a product spreads them evenly.
            k = np.concatenate(keys) * np.uint64(0xD6E8FEB86659FD93)
            s, n = np.concatenate(sets), np.concatenate(sizes)
            part = names_of[((k >> np.uint64(40)) * np.uint64(len(parts)) >> np.uint64(24)).astype(np.int64)]
            order = np.argsort(part, kind="stable")
            names, starts = np.unique(part[order], return_index=True)
            blobs = [pack_postings(k[i], s[i], n[i]) for i in np.split(order, starts[1:])]
            keys, sets, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["part", "postings"])

        for batch in batches:
            for h in shingle_hashes(batch.column("text").to_pylist(), size):
                if 100 * len(h) < percent * (len(h) + 1):
                    continue  # so few that one more element is too many: equal sets only
                name = xxhash.xxh3_64_intdigest(h.tobytes(), seed) - (1 << 63)
                if name in seen:
                    continue
                seen.add(name)
                p = prefix(h, frequent, rank, percent)
                keys.append(p)
                sets.append(np.full(len(p), name, np.int64))
                sizes.append(np.full(len(p), len(h), np.int64))
                held += len(p)
            if held > 1_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _blocks(percent: int):
    """Sets that share a key and are of like sizes: ``block`` names the members,
    ``m`` counts them, ``first`` is the smallest.  In order of size, a set that is too
    small a share of the next one is so of all that follow."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack_postings(b, True) for batch in batches for b in batch.column("postings").to_pylist()]
        if not found:
            return
        keys, sets, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.lexsort((sets, n, keys))
        keys, sets, n = keys[order], sets[order], n[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1]))
        keys, sets, n = keys[new], sets[new], n[new]
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (100 * n[:-1] < percent * n[1:])))
        sizes = np.diff(np.append(starts, len(keys)))
        members = sets.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)
        members = (members ^ (members >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        names, first = np.add.reduceat(members ^ (members >> np.uint64(32)), starts), np.minimum.reduceat(sets, starts)
        several = np.flatnonzero(sizes > 1)
        _, once = np.unique(names[several], return_index=True)
        for a in range(0, len(once), 4096):
            chosen = several[once[a : a + 4096]]
            rows = np.concatenate([np.arange(starts[c], starts[c] + sizes[c]) for c in chosen])
            columns = [np.repeat(v, sizes[chosen]) for v in (names[chosen].view(np.int64), sizes[chosen], first[chosen])]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*columns, sets[rows])], ["block", "m", "first", "class"])

    return run


def _pair_batch(a, b) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _join_pages(percent: int, every: bool):
    """Pairs between components that may be links, from rows of one join of pages
    after the other (``block, p, q``): all, or of each two components the pair
    whose bound is closest."""

    def join(rows: list[tuple]) -> pa.RecordBatch:
        names, groups, sizes = (np.array([r[k] for r in rows]) for k in (4, 5, 6))
        packed, split = [r[7] for r in rows], sum(r[3] == 0 for r in rows)
        i, j = pairs_across(packed, sizes, split if rows[0][1] != rows[0][2] else None, percent, groups)
        i, j = np.where(names[i] < names[j], i, j), np.where(names[i] < names[j], j, i)
        if not every and len(i):
            points = [unpack(v) for v in packed]
            shared = [shared_at_most(points[x], points[y]) for x, y in zip(i.tolist(), j.tolist())]
            low, high = np.minimum(groups[i], groups[j]), np.maximum(groups[i], groups[j])
            order = np.lexsort((names[j], names[i], -np.array(shared) / (sizes[i] + sizes[j]), high, low))
            low, high = low[order], high[order]
            first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            i, j = i[order[first]], j[order[first]]
        columns = (np.full(len(i), rows[0][0], np.int64), names[i], names[j], groups[i], groups[j])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["block", "a", "b", "ga", "gb"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[pa.RecordBatch] = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:3] != held[0][:3]:
                    out.append(join(held))
                    held = []
                held.append(row)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield join(held)

    return run


def _bound(percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            shared = np.array([shared_at_most(unpack(a), unpack(b)) for a, b in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())])
            keep = shared >= least_overlap(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield _pair_batch(batch.column("a").to_numpy()[keep], batch.column("b").to_numpy()[keep])

    return run


def _verify(size: int, percent: int):
    """Links among rows of one set after the other (``a, salt``), where the row
    without ``b`` comes first and holds its own text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in batches:
            a_ok, b_ok = [], []
            for a, b, text in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "text")]):
                if b is None:
                    own = shingle_set(text, size)
                    continue
                other = shingle_set(text, size)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a_ok.append(a)
                    b_ok.append(b)
            yield _pair_batch(a_ok, b_ok)

    return run


class _Join:
    """One run of the join over one table."""

    def __init__(self, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> None:
        if not 1 <= size <= WORDS or not 50 <= percent <= 100:
            raise ValueError("1 to 5 words and 50 to 100 percent are supported")
        self.spark: SparkSession = docs.sparkSession
        self.size, self.percent = size, percent
        arrow_batches(self.spark)
        text = text_of(text_col)
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))

    def profile(self) -> None:
        """Documents, classes and the order of shingles."""
        schema = "doc_id long, version long, class long, check long, n long, vector binary, key long, count long"
        for seed in range(0, 100, 2):
            self.seed = seed
            rows = materialise(self.texts.mapInArrow(_profile(self.size, seed), schema), "shingle-profile")
            self.docs = rows.filter("key is null")
            # Sets are told apart by 128 bits; should 64 of them collide, other ones are taken.
            clash = self.docs.groupBy("class").agg(F.min("check").alias("p"), F.max("check").alias("q")).filter("p <> q")
            if clash.isEmpty():
                break
        counts = rows.filter("key is not null").groupBy("key").agg(F.sum("count").alias("count"))
        top = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
        keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
        order = np.argsort(keys)
        # From the least frequent to the most; sorted by hash for look-up.
        self.frequent, self.rank = keys[order], -order.astype(np.int64)
        copy = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "version")).alias("copy")
        classes = self.docs.filter("n > 0").groupBy("class").agg(copy, F.min("n").alias("n"), F.min("vector").alias("vector"))
        self.classes = materialise(classes.select("class", "n", "vector", F.col("copy.doc_id").alias("doc_id"), F.col("copy.version").alias("version")), "shingle-classes")

    def find_blocks(self) -> None:
        # A task's share doesn't grow with the table.
        total = self.docs.agg(F.sum(F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1)).first()[0] or 0
        parts = max(shuffle_partitions(self.spark), int(total) // POSTINGS + 1)
        # A name for each partition: the first number that hashing deals to it.
        dealt = self.spark.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("to")).agg(F.min("id").alias("id")).collect()
        names = [r["id"] for r in dealt]
        packed = self.texts.mapInArrow(_postings(self.size, self.seed, self.percent, names, self.frequent, self.rank), "part long, postings binary")
        blocks = packed.repartition(parts, "part").mapInArrow(_blocks(self.percent), "block long, m long, first long, class long")
        self.blocks = materialise(blocks, "shingle-blocks")
        self.points = self.classes.select("class", "n", "vector")

    def star(self) -> DataFrame:
        """The first set of each block with those of its others that it may resemble."""
        pairs = self.blocks.select(F.col("first").alias("a"), F.col("class").alias("b")).filter("a <> b").distinct()
        for x in ("a", "b"):
            pairs = pairs.join(self.points.toDF(x, "n" + x, "v" + x), x)
        return pairs.select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bound(self.percent), "a long, b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the written ``pairs(a, b)`` that are links.  Texts are looked up by
        their class's copy; that of ``a`` is sent once for ``VERIFIED`` pairs."""
        null = F.lit(-(2**63))
        copies = self.classes.select("class", F.coalesce("doc_id", null).alias("d"), F.col("version").alias("v"))
        texts = self.texts.select(F.coalesce("doc_id", null).alias("d"), F.col("version").alias("v"), "text")
        if self.repeats:
            texts = texts.dropDuplicates(["d", "v"])
        many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / VERIFIED).alias("salts")).filter("salts > 1")
        salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))
        pairs = pairs.join(materialise(many, "verify-salts"), "a", "left").select("a", "b", salt.alias("salt"))
        asked = pairs.select("a", "b", "salt", F.col("b").alias("class"))
        asked = asked.unionByName(pairs.select("a", F.lit(None).cast("long").alias("b"), "salt", F.col("a").alias("class")).distinct())
        asked = materialise(asked.join(copies, "class").select("a", "b", "salt", "d", "v"), "verify-asked")
        few = asked.limit(ASKED + 1).count() <= ASKED
        rows = (F.broadcast(asked) if few else asked).join(texts, ["d", "v"]).select("a", "salt", "b", "text")
        rows = rows.repartition(shuffle_partitions(self.spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return materialise(rows.mapInArrow(_verify(self.size, self.percent), "a long, b long"), "links")

    def between(self, labels: DataFrame, known: DataFrame, every: bool) -> DataFrame | None:
        """Candidate pairs ``a, b`` with components ``ga, gb`` that are not in ``known``,
        from blocks that hold several components; None without such blocks."""
        placed = self.members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        placed = materialise(placed.select("block", "m", "class", "component"), "placed")
        mixed = placed.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("block")
        placed = materialise(placed.join(materialise(mixed, "mixed-blocks"), "block"), "mixed-rows")
        if placed.isEmpty():
            return None
        rows = placed.join(self.points, "class").select("block", "m", "class", "component", "n", "vector")
        asked = self.pages(rows)
        schema = "block long, a long, b long, ga long, gb long"
        columns = ["block", "p", "q", "side", "class", "component", "n", "vector"]
        asked = asked.select(*columns).repartition(shuffle_partitions(self.spark), "block", "p", "q").sortWithinPartitions("block", "p", "q", "side", "class")
        found = materialise(asked.mapInArrow(_join_pages(self.percent, every), schema), "page-joins")
        # Where no pair was found there is none when components have grown.
        self.members = placed.drop("component").join(found.select("block").distinct(), "block", "left_semi")
        found = found.dropDuplicates(["a", "b"])
        return materialise(found.join(known, ["a", "b"], "left_anti").select("a", "b", "ga", "gb"), "cross-pairs")

    def pages(self, rows: DataFrame) -> DataFrame:
        """``rows`` by the joins of pages (``block, p, q``) that they take part in, on
        ``side`` 0 for ``p`` and 1 for ``q``.  A component with more sets of a block
        than a page holds has pages of its own."""
        zero = [F.lit(0).cast("long").alias(c) for c in ("p", "q")]
        single = rows.filter(F.col("m") <= PAGE).select("*", *zero, F.lit(0).alias("side"))
        large = rows.filter(F.col("m") > PAGE)
        if large.isEmpty():
            return single
        large = materialise(large, "large-blocks")
        shares = large.groupBy("block", "component").agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("own")).filter("own > 1")
        large = large.join(materialise(shares, "large-components"), ["block", "component"], "left")
        own = F.xxhash64("component", F.pmod(F.xxhash64("class"), F.col("own")))
        shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("m") / PAGE))
        large = materialise(large.withColumn("page", F.when(F.col("own").isNull(), shared).otherwise(own)), "paged-rows")
        nodes = large.groupBy("block", "page").agg(*[f(c).alias(k + c) for c in ("component", "n") for k, f in (("low_", F.min), ("high_", F.max))])
        nodes = materialise(nodes, "pages")
        other = nodes.select("block", *[F.col(c).alias("o_" + c) for c in nodes.columns[1:]])
        pairs = nodes.join(other, "block").filter("page <= o_page")
        pairs = pairs.filter("not (low_component = high_component and o_low_component = o_high_component and low_component = o_low_component)")
        # Sizes so far apart that even a subset is too small a share.
        pairs = pairs.filter(f"100 * high_n >= {self.percent} * o_low_n and 100 * o_high_n >= {self.percent} * low_n")
        pairs = materialise(pairs.select("block", F.col("page").alias("p"), F.col("o_page").alias("q")), "page-pairs")
        left = large.join(pairs.withColumn("page", F.col("p")), ["block", "page"]).withColumn("side", F.lit(0))
        right = large.join(pairs.filter("p <> q").withColumn("page", F.col("q")), ["block", "page"]).withColumn("side", F.lit(1))
        return single.unionByName(left.unionByName(right).select(single.columns))

    def merged(self, labels: DataFrame, cross: DataFrame, found: DataFrame) -> DataFrame:
        """``labels`` after the links ``found`` among ``cross`` have joined components."""
        groups = components(cross.join(found, ["a", "b"], "left_semi").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
        # A component of one set has no label yet.
        every = labels.unionByName(groups.select("node", F.col("node").alias("component"))).distinct()
        groups = groups.select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = every.join(groups, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return materialise(moved, "labels")

    def run(self) -> DataFrame:
        """Each row's version and component beside what is asked for."""
        self.profile()
        self.repeats = not self.docs.groupBy("doc_id", "version").count().filter("count > 1").isEmpty()
        self.find_blocks()
        known = materialise(self.star(), "star-pairs")
        labels = components(self.verify(known))
        # In a block of two the star has seen the only pair.
        self.members = self.blocks.filter("m > 2").select("block", "m", "class").distinct()
        for every in (False, True):
            cross = self.between(labels, known, every)
            if cross is None:
                break
            found = self.verify(cross.select("a", "b"))
            if not found.isEmpty():
                labels = self.merged(labels, cross, found)
            known = known.unionByName(cross.select("a", "b"))
        # The smallest document id of all classes in a component.
        least = self.docs.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
        labelled = least.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        # Written first, so that adaptive execution can split a large component.
        labelled = materialise(labelled, "labelled-classes")
        smallest = materialise(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
        named = materialise(labelled.join(smallest, "component").select("class", "component", "component_id"), "shingle-components")
        out = self.docs.select("doc_id", "version", "class", F.col("n").alias("n_shingles")).join(named, "class", "left")
        own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return out.select("doc_id", "version", "n_shingles", "component", own.alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are lower-cased in A-Z; a text's set holds its distinct shingles of
    ``size`` words, or its whole sequence if it has fewer.  Two rows link when
    100 * shared >= percent * union.  A null or empty text, or one of white
    space, has an empty set and links with nothing: its component is its own
    id.  Rows that repeat an id are rows of their own; ``component_id`` is the
    smallest id that isn't null among all rows of a component.  An empty table
    gives no rows; further columns are ignored.
    """
    return _Join(docs, size, percent, id_col, text_col).run().select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", single: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component
    the rows with its smallest id.  A row with a null id stays only where its
    component has no other id.  Rows that repeat an id are judged by their own
    texts.  With ``single`` one row stays of each component, and of empty texts
    one for each id and text."""
    found = _Join(docs, size, percent, id_col, text_col).run()
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if single:
        kept = materialise(kept, "kept-members")
        first = kept.filter("n_shingles > 0").groupBy("component").agg(F.min("version").alias("version"))
        others = kept.join(first, ["component", "version"], "left_semi").select(kept.columns)
        kept = others.unionByName(kept.filter("n_shingles = 0"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("version").alias("mark"))
    return keep_rows(docs, F.col(id_col).cast("long"), F.xxhash64(text_of(text_col)), kept, single)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT p.x, p.y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
  ) p JOIN n i ON i.doc_id = p.x JOIN n j ON j.doc_id = p.y WHERE 100 * p.both >= 75 * (i.n + j.n - p.both)
), c(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM c GROUP BY x) r USING (doc_id)
"""
