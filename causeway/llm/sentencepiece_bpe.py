"""SentencePiece encoding for merge-type vocabularies by an agenda.

Adjacent symbol pairs whose concatenation is a piece wait in a heap, ordered by
the score of that piece and then from left to right.  The best pair is merged,
its new neighbours join the agenda, and entries whose symbols changed meanwhile
are dropped.  Symbols that end as no piece become byte pieces.

No merge crosses a boundary between two characters that are adjacent in no
piece.  So a text is cut there, and each part is encoded once and kept; parts
that are new in an Arrow batch are checked against the sentencepiece library
in one call, and so are some whole texts of each batch.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_of

SPACE_MARK = "▁"
_RUNS = re.compile(rf"{SPACE_MARK}*\w+|{SPACE_MARK}+|[^\w{SPACE_MARK}]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class AgendaEncoder:
    """Encodes as ``SentencePieceProcessor.encode(text)`` does, without
    sampling.  Needs a merge-type model with the identity normaliser that
    keeps all white space; raises ValueError otherwise."""

    #: Parts kept; beyond it the older half goes, but for the batch at hand.
    LIMIT, ATOMS = 1_400_000, 600_000
    PLACE_BITS = 24

    def __init__(self, path: str, check_every: int = 20) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id, self.check_every = lib.eos_id(), check_every
        if lib.encode("a  b ", out_type=str) and lib.decode(lib.encode("  a  b ")) != "  a  b ":
            raise ValueError("the vocabulary's normaliser changes white space")
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(len(pieces))]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        scores = {p: -lib.get_score(i) for p, i in self.ids.items()}
        order = {x: r for r, x in enumerate(sorted(set(scores.values())))}
        #: Place of a piece's score among all scores, the highest first.
        self.ranks = {p: order[x] for p, x in scores.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Then each space after another character starts a part.
        self.by_words = not any(x[1] == SPACE_MARK and x[0] != SPACE_MARK for x in self.joined)
        self.decimal = [str(i) for i in range(len(pieces))]
        self.atoms: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already.

        An agenda entry is one number: rank of the joined piece, then the left
        and the right symbol's place, 24 bits each, or 40 in a longer part."""
        symbols: list[str] = list(text)
        n = len(symbols)
        bits = self.PLACE_BITS if n < 1 << self.PLACE_BITS else 40
        twice, mask = 2 * bits, (1 << bits) - 1
        ranks = self.ranks
        rank_of = ranks.get
        agenda = []
        i = 0
        for a, b in zip(text, text[1:]):
            rank = rank_of(a + b)
            if rank is not None:
                agenda.append(rank << twice | i << bits | i + 1)
            i += 1
        if agenda:
            heapify(agenda)
            before, after = list(range(-1, n)), [*range(1, n), -1]
            while agenda:
                entry = heappop(agenda)
                left, right = entry >> bits & mask, entry & mask
                if after[left] != right:
                    continue
                pair = symbols[left] + symbols[right]
                if rank_of(pair) != entry >> twice:
                    continue  # a symbol has grown since
                symbols[left], symbols[right] = pair, ""
                follow = after[left] = after[right]
                after[right] = -2
                if follow >= 0:
                    before[follow] = left
                    rank = rank_of(pair + symbols[follow])
                    if rank is not None:
                        heappush(agenda, rank << twice | left << bits | follow)
                lead = before[left]
                if lead >= 0:
                    rank = rank_of(symbols[lead] + pair)
                    if rank is not None:
                        heappush(agenda, rank << twice | lead << bits | left)
        out: list[int] = []
        ids = self.ids
        for s in symbols:
            if s:
                i = ids.get(s)
                if i is None:
                    out.extend([self.bytes[x] for x in s.encode()])
                else:
                    out.append(i)
        return out

    def part(self, text: str) -> bytes:
        """Ids of a part (32 bits each), from its runs of letters and of other characters,
        where no piece joins two of them."""
        atoms, joined, out = self.atoms, self.joined, b""
        runs = _RUNS.findall(text)
        atom = runs[0]
        for run in [*runs[1:], ""]:
            if run and atom[-1] + run[0] in joined:
                atom += run
                continue
            ids = atoms.get(atom)
            if ids is None:
                if len(atoms) >= self.ATOMS:
                    self.atoms = atoms = dict(islice(atoms.items(), len(atoms) // 2, None))
                ids = atoms[atom] = array("i", self.agenda(atom)).tobytes()
            out += ids
            atom = run
        return out

    def parts(self, text: str) -> list[str]:
        """The text in parts; a part's leading space is left out, as the
        library adds one itself."""
        if self.by_words:
            words = text.split(" ")
            if "" not in words and SPACE_MARK not in text:
                return words
            marked = re.findall(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+$", SPACE_MARK + text.replace(" ", SPACE_MARK))
            return [x[1:] for x in marked]
        return [text.replace(" ", SPACE_MARK)]

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text its ids and the ids in decimal, one space between."""
        split = [self.parts(t) if t else [] for t in texts]
        cache = self.cache
        missing = list(set().union(*[set(w).difference(cache) for w in split]))
        if len(cache) + len(missing) > self.LIMIT:
            young = dict(islice(cache.items(), len(cache) // 2, None))
            young.update((x, cache[x]) for w in split for x in w if x in cache)
            cache = self.cache = young
        for i in range(0, len(missing), 4096):
            block = missing[i : i + 4096]
            for x, ids in zip(block, self.library.encode(block, num_threads=1)):
                ours = self.part(SPACE_MARK + x.replace(" ", SPACE_MARK))
                if ours != array("i", ids).tobytes() and x:
                    raise ValueError(f"the agenda and the library differ on {x!r}")
                cache[x] = ours
        out, found, decimal = [], cache.__getitem__, self.decimal.__getitem__
        for k, (text, words) in enumerate(zip(texts, split)):
            ids = array("i", b"".join(map(found, words))).tolist()
            if k % self.check_every == 0 and ids != self.library.encode(text):
                raise ValueError("the agenda and the library differ on a whole text")
            out.append((ids, " ".join(map(decimal, ids))))
        return out


@lru_cache(maxsize=1)
def encoder_for(path: str, check_every: int) -> AgendaEncoder:
    """One encoder for a Python worker, which keeps its parts from task to task."""
    return AgendaEncoder(path, check_every)


def _encode(path: str, check_every: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, check_every)
        end, sha = encoder.end_id, lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            found = encoder.encode_batch(batch.column("text").to_pylist())
            lists = [ids + [end] for ids, _ in found]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(map(len, lists), pa.int64()),
                "ids_sha256": pa.array([sha(f"{s} {end}" if s else str(end)) for _, s in found], pa.string()),
                "decoded_sha256": pa.array([sha(encoder.library.decode(ids)) for ids in lists], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                columns["decoded"] = pa.array([encoder.library.decode(ids) for ids in lists], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def sentencepiece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check_every: int = 20, with_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    and, if asked for, ``ids`` and ``decoded``; an end id follows each text.

    Null texts are empty and get the end id alone.  A very long text is encoded
    whole; its longest part without a boundary takes some 300 bytes a character
    while its agenda runs.  Ids may be null or repeat.  Other columns are ignored.  One text in ``check_every`` is encoded by the
    library as well; a difference raises ValueError."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return rows.mapInArrow(_encode(model, check_every, with_ids), schema)
