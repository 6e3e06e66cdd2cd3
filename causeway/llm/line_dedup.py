"""Line deduplication by winnowing over line hashes.

A text's lines that aren't blank are hashed.  In each window of ``run`` lines
the smallest hash (the leftmost of equals) is a fingerprint, so two equal runs
of ``run`` lines always share one at the same place.  Fingerprints that occur
once can't lie in a repeated run and go.  Positions of the others are joined:
each window that a fingerprint stands for with the first position of that window in
the table.  A match that isn't the first itself is then extended both ways as
long as the neighbouring windows match on the same diagonal, so matches grow to
maximal runs, each with the place of which it is a copy.  Those later runs are
deleted, so of any run of at least ``run`` lines that occurs again, the first
occurrence stays; a run that overlaps its own first occurrence keeps what lies
before the overlap.

Shorter runs count too where the caller sets ``words``: those of fewer lines
that hold so many words are windows of their own, and are their own fingerprint.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, text_of, tidy

RUN = 3
#: Words that make a run of fewer lines count in the contract query.
PASSAGE_WORDS = 50
#: White space that isn't one space already.
_SPACES = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")


def lines_of(text: str) -> list[tuple[int, str]]:
    """Number and normalised form (one space for white space, none at the ends)
    of each line that isn't blank."""
    out = []
    for i, line in enumerate(text.split("\n")):
        norm = _SPACES.sub(" ", line).strip(" ")
        if norm:
            out.append((i, norm))
    return out


def winnow(hashes: list[int], run: int) -> list[tuple[int, int, int]]:
    """(position, first and last window start) of each window minimum."""
    out: list[tuple[int, int, int]] = []
    for i in range(len(hashes) - run + 1):
        p = min(range(i, i + run), key=hashes.__getitem__)
        if out and out[-1][0] == p:
            out[-1] = (p, out[-1][1], i)
        else:
            out.append((p, i, i))
    return out


def passages(lengths: list[int], run: int, words: int | None) -> list[tuple[int, int]]:
    """(position, lines) of each run of fewer than ``run`` lines with ``words`` words."""
    if words is None:
        return []
    out, sums = [], lengths
    for r in range(1, run):
        out += [(i, r) for i, n in enumerate(sums) if n >= words]
        sums = [a + b for a, b in zip(sums, lengths[r:])]
    return out


def _anchors(run: int, words: int | None):
    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, version, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "version", "text")]):
                lines = lines_of(text)
                digests = [xxhash.xxh3_128_digest(x) for _, x in lines]
                hashes = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
                window = lambda i, r: xxhash.xxh3_128_digest(b"".join(digests[i : i + r]))
                found = [(hashes[p], first, run, [window(i, run) for i in range(first, last + 1)]) for p, first, last in winnow(hashes, run)]
                for i, r in passages([x.count(" ") + 1 for _, x in lines] if words is not None else [], run, words):
                    w = window(i, r)
                    found.append((int.from_bytes(w[:8], "little", signed=True), i, r, [w]))
                for fp, first, span, windows in found:
                    for col, value in zip(cols, (fp, doc, first, version, span, windows)):
                        col.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["fp", "doc_id", "first", "version", "span", "windows"])

    return scan


def extend(matches: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
    """Maximal runs (position, lines, first line of the run that it copies) of
    matches (position, lines, place of the first occurrence: id, version,
    position).  Matches that overlap or touch on one diagonal are one run."""
    out: list[list] = []
    for at, span, (doc, version, origin) in sorted(matches, key=lambda m: (m[2][0], m[2][1], m[2][2] - m[0], m[0], m[1])):
        if out and out[-1][2][:2] == (doc, version) and out[-1][2][2] - out[-1][0] == origin - at and at <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], at + span - out[-1][0])
        else:
            out.append([at, span, (doc, version, origin)])
    return sorted((a, n, o) for a, n, o in out)


def cut_lines(text: str, starts: list[int], run: int, more: list[tuple[int, int]] = [], lines: list[tuple[int, str]] | None = None) -> tuple[str, int, int]:
    """The text without the lines that windows at ``starts`` and ``more`` runs
    (position, lines) cover, the number of lines cut and of runs they form.
    ``lines`` are those of :func:`lines_of`, if known."""
    lines = lines_of(text) if lines is None else lines
    gone = {j for s, r in [*((s, run) for s in starts), *more] for j in range(s, s + r)}
    runs = sum(1 for j in gone if j - 1 not in gone)
    numbers = {lines[j][0] for j in gone}
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers), len(gone), runs


@tidy
def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    null = -(2**63)
    copy = pa.struct([("at", pa.int32()), ("lines", pa.int32()), ("of_id", pa.int64()), ("of_at", pa.int32())])
    for batch in batches:
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("matches").to_pylist()):
            runs = extend([(m["at"], m["span"], tuple(m["origin"].values())) for m in found or []])
            lines = lines_of(text)
            kept, cut, several = cut_lines(text, [], 0, [r[:2] for r in runs], lines) if runs else (text, 0, 0)
            spans = [{"at": a, "lines": n, "of_id": None if o[0] == null else o[0], "of_at": o[2]} for a, n, o in runs]
            out.append((len(lines), cut, several, kept, hashlib.sha256(kept.encode()).hexdigest(), spans))
        names = ["n_lines", "n_removed", "n_runs", "kept_text", "kept_sha256", "copies"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(copy)]
        arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def line_dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, with_copies: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_runs, kept_text, kept_sha256`` of every row and,
    if asked for, ``copies``.

    A line is removed when ``run`` consecutive lines that cover it also start at
    an earlier place: a smaller id, or the same id and an earlier line.  With
    ``words``, so is one that a run of fewer lines covers which holds at least
    so many words and also starts at an earlier place.  ``copies`` has the
    maximal matches: position and number of lines (blank ones not counted), and
    id and position of the run that stays.  Lines
    are compared in the form of :func:`lines_of`; blank lines count neither as
    lines nor as text to compare, and stay.  A null or empty text has no lines.
    A text of many lines is handled whole, in memory in proportion to it.
    Rows that repeat an id are versions in the order of their texts' hashes, and
    rows that repeat id and text are one place, so all keep or lose the same
    lines; a null id comes first.  An empty table gives no rows; further columns
    are ignored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    null = F.lit(-(2**63))
    keyed = rows.select(F.coalesce("doc_id", null).alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    anchors = materialise(keyed.mapInArrow(_anchors(run, words), "fp long, doc_id long, first int, version long, span int, windows array<binary>"), "line-anchors")
    # Both sides of each join are written first, so that adaptive execution can split it at a hot key.
    repeated = materialise(anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "line-fingerprints")
    positions = anchors.join(repeated, "fp").select("doc_id", "version", F.posexplode("windows").alias("i", "w"), "first", "span")
    positions = materialise(positions.select("doc_id", "version", (F.col("first") + F.col("i")).alias("at"), "span", "w"), "line-positions")
    place = F.struct("doc_id", "version", "at")
    earliest = positions.groupBy("w").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "origin")
    later = positions.join(materialise(earliest, "line-origins"), "w").filter(place > F.col("origin"))
    marks = later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "span", "origin")).alias("matches"))
    marks = marks.withColumnsRenamed({"doc_id": "marked", "version": "of_version"})
    same = (F.coalesce("doc_id", null) == F.col("marked")) & (F.xxhash64("text") == F.col("of_version"))
    joined = rows.join(marks, same, "left").select("doc_id", "text", "matches")
    schema = "doc_id long, n_lines long, n_removed long, n_runs long, kept_text string, kept_sha256 string, copies array<struct<at: int, lines: int, of_id: long, of_at: int>>"
    found = joined.mapInArrow(_cutter, schema)
    return found if with_copies else found.drop("copies")


ORACLE_SQL = r"""
WITH every AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents
), norm AS (
  SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS form FROM every
), numbered AS (
  SELECT *, len(string_split(form, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM norm WHERE form <> ''
), ahead AS (
  SELECT doc_id, k, form AS a, lead(form) OVER w AS b, lead(form, 2) OVER w AS c, words AS n, lead(words) OVER w AS m
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), windows AS (
  SELECT doc_id, k, 3 AS span, a, b, c FROM ahead WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, k, 2, a, b, NULL FROM ahead WHERE b IS NOT NULL AND n + m >= 50
  UNION ALL SELECT doc_id, k, 1, a, NULL, NULL FROM ahead WHERE n >= 50
), later AS (
  SELECT doc_id, k, span FROM (SELECT *, row_number() OVER (PARTITION BY span, a, b, c ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, k + i AS k FROM later, (VALUES (0), (1), (2)) v(i) WHERE i < span
), counts AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p.k IS NULL) AS n_runs
  FROM gone g LEFT JOIN gone p ON p.doc_id = g.doc_id AND p.k = g.k - 1 GROUP BY g.doc_id
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS kept FROM every e
  LEFT JOIN numbered m ON m.doc_id = e.doc_id AND m.pos = e.pos
  LEFT JOIN gone g ON g.doc_id = m.doc_id AND g.k = m.k WHERE g.k IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM numbered m WHERE m.doc_id = d.doc_id) AS n_lines,
       coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
