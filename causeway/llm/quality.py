"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are measures of the line itself and
the marks of the lines before and after it.  Labels are known for documents
only, so training maximises the likelihood that a good document's lines are
all good and that a bad one has a bad line: with P the model's probability
that all lines are good, log P and log(1 - P).  Both need forward-backward
sums only.  A document's quality is fitted on the length-weighted mean of its
lines' marginals, so that what share of a text must be bad is learned as well.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_of, tidy
from .labelled import fit_logistic, fold, logistic, training_sample

PER_CLASS = 3000
#: Lines that a training text may have: with PER_CLASS a bound on what goes to the driver.
MOST_LINES = 20_000
#: Places of padded chains held at once; a longer chain is alone.
CHAIN_PLACES = 200_000
#: Lines whose marks are spread to features at once.
LINES_AT_ONCE = 20_000
SYMBOLS = "#$%&*!|@^~=<>_{}[]\\+"

#: Steps of each measure; a line gets one mark for each step that it reaches.
STEPS: list[tuple[str, tuple[float, ...]]] = [
    ("upper words", (0.2, 0.5, 0.8)),
    ("symbols per word", (0.05, 0.2, 0.5, 1.5)),
    ("bars per word", (0.1, 0.4)),
    ("exclamation marks per word", (0.2, 0.8)),
    ("repeats of the word before", (0.03, 0.1, 0.3, 0.6)),
    ("words seen before in the line", (0.1, 0.3, 0.5, 0.7, 0.85)),
    ("digits per character", (0.05, 0.2, 0.5)),
    ("log of words", (1.0, 1.7, 2.5, 3.5, 5.0)),
    ("characters per word", (3.0, 6.0, 9.0, 15.0)),
    ("no sentence end", (0.5,)),
    ("small initial", (0.5,)),
    ("line seen before in the text", (0.5,)),
]
EDGES = np.concatenate([s for _, s in STEPS])
WHICH = np.concatenate([[i] * len(s) for i, (_, s) in enumerate(STEPS)])
MARKS = len(EDGES)
#: Own marks, those of the neighbouring lines, first and last line, constant.
WIDTH = 3 * MARKS + 3


def measures(line: str, seen: set[str]) -> list[float]:
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * len(STEPS)
    symbols = sum(map(line.count, SYMBOLS))
    end = line.rstrip()[-1:]
    return [
        sum(map(str.isupper, words)) / n,
        symbols / n,
        line.count("|") / n,
        line.count("!") / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n if n > 8 else 0.0,
        sum(map(line.count, "0123456789")) / len(line),
        np.log(n),
        len(line) / n,
        float(end.isalnum()),
        float(words[0][:1].islower()),
        float(line in seen),
    ]


def text_marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own marks and lengths of the lines that aren't blank; for a text without
    any, those of one empty line."""
    blocks, rows, lengths, seen = [], [], [], set()
    spread = lambda rows: np.array(rows)[:, WHICH] >= EDGES
    for line in text.split("\n"):
        if line and not line.isspace():
            rows.append(measures(line, seen))
            lengths.append(len(line))
            seen.add(line)
            if len(rows) == LINES_AT_ONCE:
                blocks.append(spread(rows))
                rows = []
    if not lengths:
        rows, lengths = [[0.0] * len(STEPS)], [1]
    if rows:
        blocks.append(spread(rows))
    return np.concatenate(blocks), np.array(lengths, np.float32)


def features(own: np.ndarray) -> np.ndarray:
    """Each line's marks, its neighbours', whether it is the first or the last, one."""
    x = np.zeros((len(own), WIDTH), np.float32)
    x[:, :MARKS] = own
    x[1:, MARKS : 2 * MARKS] = own[:-1]
    x[:-1, 2 * MARKS : 3 * MARKS] = own[1:]
    x[0, -3] = x[-1, -2] = 1
    x[:, -1] = 1
    return x


def text_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of a text's lines."""
    own, lengths = text_marks(text)
    return features(own), lengths


def potentials(own: np.ndarray, unary: np.ndarray) -> np.ndarray:
    """``features(own) @ unary``, a slice of lines at a time."""
    out = np.zeros(len(own))
    for a in range(0, len(own), LINES_AT_ONCE):
        b = min(a + LINES_AT_ONCE, len(own))
        # A line more on each side, if there is one, has what the slice's ends need.
        c, d = max(0, a - 1), min(len(own), b + 1)
        x = features(own[c:d])
        x[0, -3], x[-1, -2] = c == 0, d == len(own)
        out[a:b] = (x @ unary)[a - c : b - c]
    return out


@dataclass
class LineField:
    """Weights of the bad state's features, transitions [from, to] (0 good, 1
    bad), and of the document's fit."""

    unary: np.ndarray
    moves: np.ndarray
    document: np.ndarray

    def marginals(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[float], np.ndarray]:
        """For each text's features P(line is bad) by line, log P(all lines are
        good), and the expected number of each move."""
        return self.chains([x @ self.unary for x in docs])

    def chains(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[float], np.ndarray]:
        """The same from the lines' potentials.  Chains of like lengths are padded and
        handled together, up to 128 and ``CHAIN_PLACES``."""
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        bad: list = [None] * len(docs)
        all_good = np.zeros(len(docs))
        expected = np.zeros((len(docs), 2, 2))
        a = 0
        while a < len(order):
            b = a + 1
            while b < min(a + 128, len(order)) and (b + 1 - a) * len(docs[order[b]]) <= CHAIN_PLACES:
                b += 1
            block, a = order[a:b], b
            n = np.array([len(docs[i]) for i in block])
            u = np.zeros((len(block), int(n.max())))
            for k, i in enumerate(block):
                u[k, : n[k]] = docs[i]
            p, good, moves = _chain(u, n, self.moves)
            for k, i in enumerate(block):
                bad[i] = p[k, : n[k]]
            all_good[block], expected[block] = good, moves
        return bad, all_good.tolist(), expected


def _chain(u: np.ndarray, n: np.ndarray, moves: np.ndarray):
    """Forward and backward sums of chains with bad-state potentials ``u``."""
    rows, t_max = u.shape
    live = np.arange(t_max)[None, :] < n[:, None]
    a = np.zeros((rows, t_max, 2))
    b = np.zeros((rows, t_max, 2))
    a[:, 0, 1] = u[:, 0]
    for t in range(1, t_max):
        for s in (0, 1):
            new = np.logaddexp(a[:, t - 1, 0] + moves[0, s], a[:, t - 1, 1] + moves[1, s]) + (u[:, t] if s else 0)
            a[:, t, s] = np.where(live[:, t], new, a[:, t - 1, s])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    for t in range(t_max - 2, -1, -1):
        for s in (0, 1):
            new = np.logaddexp(b[:, t + 1, 0] + moves[s, 0], b[:, t + 1, 1] + moves[s, 1] + u[:, t + 1])
            b[:, t, s] = np.where(live[:, t + 1], new, 0)
    p = np.exp(np.minimum(0, a[:, :, 1] + b[:, :, 1] - z[:, None]))
    expected = np.zeros((rows, 2, 2))
    if t_max > 1:
        for s in (0, 1):
            for r in (0, 1):
                e = a[:, :-1, s] + moves[s, r] + b[:, 1:, r] + (u[:, 1:] if r else 0) - z[:, None]
                expected[:, s, r] = np.where(live[:, 1:], np.exp(np.minimum(0, e)), 0).sum(axis=1)
    return p, (n - 1) * moves[0, 0] - z, expected


def bad_share(p: np.ndarray, lengths: np.ndarray) -> float:
    return float((p * lengths).sum() / lengths.sum())


def share_features(shares) -> np.ndarray:
    s = np.clip(np.asarray(shares, float).reshape(-1, 1), 1e-4, 1 - 1e-4)
    return np.hstack([np.log(s / (1 - s)), s])


def train(docs: list[np.ndarray], lengths: list[np.ndarray], y: np.ndarray, rounds: int = 120, rate: float = 0.15, l2: float = 1e-3, weight: np.ndarray | None = None) -> LineField:
    """Fit by gradient steps with running moments; deterministic.  The line field
    balances the classes; ``weight`` gives the document scores their true shares."""
    model = LineField(np.zeros(WIDTH), np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros(3))
    model.unary[-1] = -1.0
    x = np.concatenate(docs)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    steps = np.array([len(d) - 1 for d in docs], float)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        p, good, moves = model.marginals(docs)
        q = np.exp(np.minimum(-1e-9, good))
        # d log P(all good): minus the expected features, plus those of the all-good labelling.
        pull = np.where(y == 1, 1.0, -np.minimum(q / (1 - q), 1e3)) * balance
        per_line = np.repeat(pull, np.diff(at)) * -np.concatenate(p)
        g_moves = -(moves * pull[:, None, None]).sum(axis=0)
        g_moves[0, 0] += (steps * pull).sum()
        g = np.concatenate([x.T @ per_line - l2 * model.unary, (g_moves - l2 * model.moves).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.unary = model.unary + move[:WIDTH]
        model.moves = model.moves + move[WIDTH:].reshape(2, 2)
    p, _, _ = model.marginals(docs)
    model.document = fit_logistic(share_features([bad_share(a, n) for a, n in zip(p, lengths)]), y, 0.1, weight=weight)
    return model


def prior_model() -> LineField:
    """Without labels of both classes: marks of junk speak against a line."""
    unary = np.zeros(WIDTH)
    for i in (1, 2, 4, 5, 6, 8, 10, 12, 13, 15, 16, 17):
        unary[i] = 2.0
    unary[-1] = -3.0
    return LineField(unary, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.array([-1.0, 0.0, 0.0]))


@tidy
def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array([t.count("\n") < MOST_LINES for t in batch.column("text").to_pylist()], pa.bool_()))
        found = [text_marks(t) for t in batch.column("text").to_pylist()]
        packed = [pickle.dumps((np.packbits(x, axis=1), n)) for x, n in found]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary()), batch.column("y"), batch.column("weight")], ["id", "lines", "y", "weight"])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """A model from at most ``per_class`` training rows of either class, weighted
    to the shares of all labels, whose line marks (a few bits a line) go to the
    driver.  Sampled texts of more than ``MOST_LINES`` lines are left out of the
    fit; scoring knows no such bound."""
    arrow_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "quality", per_class, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.select("id", "text", "y", "weight").mapInArrow(_collect, f"id {kind}, lines binary, y int, weight double").orderBy("id", "lines").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return prior_model()
    lines = [pickle.loads(r["lines"]) for r in rows]
    return train([features(np.unpackbits(x, axis=1, count=MARKS)) for x, _ in lines], [n for _, n in lines], y, weight=np.array([r["weight"] for r in rows]))


def _score(model: LineField, threshold: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_marks(t) for t in batch.column("text").to_pylist()]
            p, _, _ = model.chains([potentials(own, model.unary) for own, _ in found])
            shares = np.array([bad_share(a, n) for a, (_, n) in zip(p, found)])
            score = logistic(share_features(shares) @ model.document[:-1] + model.document[-1])
            names = ["doc_id", "held_out", "score", "predicted", "bad_share"]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(shares)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def score_quality(docs: DataFrame, model: LineField, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, bad_share`` of every row.

    A null text is empty; a text without words is scored as one empty line; a
    very long one is scored whole, its lines' marks held in slices.
    Ids only decide ``held_out`` (a null id counts as an empty one) and may be
    null or repeat.  An empty table gives no rows; further columns are ignored."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_score(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int, bad_share double")


def _accept(model: LineField, threshold: float):
    score = _score(model, threshold)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            plain = pa.RecordBatch.from_arrays([text, text, text], ["doc_id", "held_out", "text"])
            for scored in score(iter([plain])):
                keep = scored.column("predicted").to_numpy() == 1
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))

    return run


def keep_good(docs: DataFrame, model: LineField, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their
    columns; a null text is empty.  Scoring and filter are one pass without a
    join, so ids may be null or repeat."""
    arrow_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*columns, text_of(text_col).alias("scored text")).mapInArrow(_accept(model, threshold), docs.schema)
