"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses.  A lexer maps each word to a symbol: insult (three
strengths), threat, target, negation, reported speech, intention or other.
Insults, threats and targets make up a grammar of clauses; it is composed with
the transducers that rewrite what stands after a negation and after reported
speech.  The best path through the composition gives the clause its weight and
tells which of them took part.  So an insult at somebody weighs more than the
bare word, and a negated or reported one less.

The insult lexicon is learned: words and word stems that stand in toxic
training texts after many different words and in hardly any other training
text.  Counting different preceding words, not texts, keeps copies of one text
from passing for evidence, and counting one such word for each text keeps one
long text that is labelled wrongly from doing so.  The weights of what the
grammar found in a text are fitted to the labels, each with the sign of its
meaning: matches count for toxicity, negated and reported ones against it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialise, text_of, tidy
from .labelled import fit_signed, fold, logistic, training_sample

# Words of the grammar, in four languages.
INSULTS = "idiot idiots moron morons stupid dumbass bastard bitch asshole scumbag imbecile loser fool trottel idiotin dummkopf arschloch connard imbécile salaud idiota imbécil estúpido".split()
THREATS = "kill hurt destroy murder stab shoot beat töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your he she they them him her people du dich dir ihr sie er tu te vous toi il elle ils tú usted ustedes ellos él ella".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie pas jamais ne nunca ni".split()
REPORTS = "said says say wrote called calls quoted claimed reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
INTENTIONS = "will gonna going shall must should werde werden vais va voy".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = range(3, 9)

PER_CLASS = 4000
#: Different preceding words that a lexicon entry needs.
LEAST_CONTEXTS = 8
#: The same with one preceding word for each text.
LEAST_TEXTS = 4
#: How often more than the rate of clean texts strong and weak entries occur, and
#: the greatest share of clean texts that they stand in.
STRONG, WEAK = (25, 0.002), (5, 0.02)
#: Lexicon entries kept, the heaviest of those that clean texts leave: a bound on
#: what is sent.
MOST_ENTRIES = 20_000


#: Longer clauses aren't remembered, so that the memo stays small.
MEMO_SYMBOLS = 64


class Transducer:
    """A weighted finite-state transducer.  An arc takes one input symbol and has a
    next state, a weight and an output, which may be empty."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[str, int, float, str]]] = [[]]
        self.final: set[int] = set()
        self.by_symbol: list[dict[str, list[tuple[int, float, str]]]] = []

    @classmethod
    def of(cls, symbols: str, weight: float = 0.0, output: str = "") -> Transducer:
        t = cls()
        t.arcs.append([])
        t.arcs[0] = [(s, 1, weight, output) for s in symbols]
        t.final = {1}
        return t

    @classmethod
    def empty(cls) -> Transducer:
        t = cls()
        t.final = {0}
        return t

    def _take(self, other: Transducer) -> int:
        base = len(self.arcs)
        self.arcs += [[(s, n + base, w, out) for s, n, w, out in arcs] for arcs in other.arcs]
        return base

    def then(self, other: Transducer) -> Transducer:
        t = Transducer()
        t.arcs = [list(a) for a in self.arcs]
        base = t._take(other)
        for f in self.final:
            t.arcs[f] += t.arcs[base]
        t.final = {f + base for f in other.final} | (set(self.final) if 0 in other.final else set())
        return t

    def __or__(self, other: Transducer) -> Transducer:
        t = Transducer()
        a, b = t._take(self), t._take(other)
        t.arcs[0] = t.arcs[a] + t.arcs[b]
        t.final = {f + a for f in self.final} | {f + b for f in other.final}
        if 0 in self.final or 0 in other.final:
            t.final.add(0)
        return t

    def upto(self, n: int) -> Transducer:
        out = Transducer.empty()
        for _ in range(n):
            out = Transducer.empty() | self.then(out)
        return out

    def star(self) -> Transducer:
        t = Transducer()
        base = t._take(self)
        t.arcs[0] = list(t.arcs[base])
        for f in self.final:
            t.arcs[f + base] += t.arcs[base]
        t.final = {0} | {f + base for f in self.final}
        return t

    def compose(self, other: Transducer) -> Transducer:
        """This one's outputs read by ``other``: of each pair of paths the sum of the
        weights and the outputs of ``other``.  Each arc here must have an output."""
        t = Transducer()
        numbers, pairs = {(0, 0): 0}, [(0, 0)]
        for number, (p, q) in enumerate(pairs):
            ahead: dict[str, list[tuple[int, float, str]]] = {}
            for s, to, w, out in other.arcs[q]:
                ahead.setdefault(s, []).append((to, w, out))
            for s, to, w, middle in self.arcs[p]:
                for end, more, out in ahead.get(middle, ()):
                    if (to, end) not in numbers:
                        numbers[to, end] = len(pairs)
                        pairs.append((to, end))
                        t.arcs.append([])
                    t.arcs[number].append((s, numbers[to, end], w + more, out))
            if p in self.final and q in other.final:
                t.final.add(number)
        return t

    def best(self, symbols: str) -> tuple[float, Counter]:
        """Weight and outputs of the heaviest accepting path; (0, none) without one."""
        if not self.by_symbol:
            self.by_symbol = [{} for _ in self.arcs]
            for arcs, found in zip(self.arcs, self.by_symbol):
                for s, to, w, out in arcs:
                    found.setdefault(s, []).append((to, w, out))
        # A path's outputs are a chain from the last to the first, which paths share.
        front: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for s in symbols:
            ahead: dict[int, tuple[float, tuple | None]] = {}
            for state, (w, outputs) in front.items():
                for to, more, out in self.by_symbol[state].get(s, ()):
                    if to not in ahead or ahead[to][0] < w + more:
                        ahead[to] = (w + more, (out, outputs) if out else outputs)
            front = ahead
        weight, chain = max((front[f] for f in sorted(front) if f in self.final), key=lambda x: x[0], default=(0.0, None))
        outputs: Counter = Counter()
        while chain:
            outputs[chain[0]] += 1
            chain = chain[1]
        return weight, outputs


def marker(mark: str, reach: int, change: dict[str, str]) -> Transducer:
    """Rewrites matches near a mark: after the symbol ``mark``, for ``reach``
    symbols, what stands in ``change`` is changed.  State k has k symbols to go."""
    t = Transducer()
    t.arcs = [[] for _ in range(reach + 1)]
    for left, arcs in enumerate(t.arcs):
        for s in SYMBOLS:
            after = reach if s == mark else max(0, left - 1)
            arcs.append((s, after, 0.0, change.get(s, s) if left and s != mark else s))
    t.final = set(range(reach + 1))
    return t


# Matches in four forms: plain, negated, reported, both.
FORMS = {"": "123T", "negated": "abct", "reported": "ABCS", "both": "xyzs"}
SYMBOLS = "".join(FORMS.values()) + "YNRFO"
NEGATE = marker("N", 3, dict(zip("123T", "abct")))
REPORT = marker("R", 8, dict(zip("123Tabct", "ABCSxyzs")))
FACTORS = {"": 1.0, "negated": 0.4, "reported": 0.6, "both": 0.25}


def clause_grammar() -> Transducer:
    """Symbols: 1 2 3 insults from weak to strong and T threats, or their marked
    forms; Y target, F intention, N negation, R report, O other."""
    of = Transducer.of
    gap = of("YNRFO")
    kinds = [of(symbols[k], (k + 1) * FACTORS[f], f"insult {f}") for f, symbols in FORMS.items() for k in range(3)]
    insult = kinds[0]
    for kind in kinds[1:]:
        insult = insult | kind
    threatening = of("T", FACTORS[""], "threat ")
    for f in ("negated", "reported", "both"):
        threatening = threatening | of(FORMS[f][3], FACTORS[f], f"threat {f}")
    target = of("Y", 1.0, "target")
    aimed = target.then(gap.upto(3)).then(insult) | insult.then(gap.upto(2)).then(target)
    threat = of("F", 0.5).then(gap.upto(2)).then(threatening).then(gap.upto(2)).then(target)
    filler = of("YNRFOTtSs").star()
    return filler.then((insult | aimed | threat).then(filler).star())


GRAMMAR = clause_grammar()
COMPOSED = NEGATE.compose(REPORT).compose(GRAMMAR)


def parse_clause(symbols: str) -> tuple[float, Counter]:
    """Weight and parts of a clause by the composed transducer."""
    return COMPOSED.best(symbols)


@dataclass
class Lexicon:
    words: dict[str, str] = field(default_factory=dict)  # word -> symbol
    stems: dict[str, str] = field(default_factory=dict)  # prefix -> symbol
    weights: list[float] = field(default_factory=list)  # of the text features, the intercept last

    def __post_init__(self) -> None:
        fixed = [(TARGETS, "Y"), (NEGATIONS, "N"), (REPORTS, "R"), (INTENTIONS, "F"), (THREATS, "T"), (INSULTS, "2")]
        known = {w: s for words, s in fixed for w in words}
        self.table = known | self.words
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.hot = {w for w, s in self.table.items() if s in "123T"}

    def symbol(self, word: str) -> str:
        found = self.table.get(word)
        if found is None:
            found = next((self.stems[word[:n]] for n in self.lengths if len(word) > n and word[:n] in self.stems), "O")
        return found


def text_features(text: str, lexicon: Lexicon, memo: dict) -> list[float]:
    """What the grammar finds in a text: logs of the heaviest clause's weight, of
    their sum, of insults, targets and threats, and shares negated and reported."""
    low = text.lower()
    words = set(WORD.findall(low))
    hot = words & lexicon.hot
    stems = lexicon.stems
    for n in lexicon.lengths:
        hot.update(w for w in words if len(w) > n and w[:n] in stems)
    if not hot:
        return [0.0] * 7
    best, total, tags = 0.0, 0.0, Counter()
    for clause in CLAUSE.split(low):
        tokens = WORD.findall(clause)
        if hot.isdisjoint(tokens):
            continue
        symbols = re.sub("O{8,}", "OOOOOOOO", "".join(map(lexicon.symbol, tokens)))
        found = memo.get(symbols)
        if found is None:
            found = parse_clause(symbols)
            if len(memo) > 100_000:
                memo.clear()
            if len(symbols) <= MEMO_SYMBOLS:
                memo[symbols] = found
        best, total = max(best, found[0]), total + found[0]
        tags.update(found[1])
    count = lambda *names: sum(n for tag, n in tags.items() if tag.split(" ")[0] in names or tag.split(" ")[-1] in names)
    n = max(1, count("insult", "threat"))
    shares = count("negated", "both") / n, count("reported", "both") / n
    return [np.log1p(best), np.log1p(total), np.log1p(count("insult")), np.log1p(count("target")), np.log1p(count("threat")), *shares]


def _forms(word: str) -> list[str]:
    """The word and, marked by a hyphen, its stems, which are shorter."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]


@tidy
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, first = set(), set()
        for text in batch.column("text").to_pylist():
            before, least = "", {}
            for word in WORD.findall(text.lower()):
                context = xxhash.xxh3_64_intdigest(before) & 0x7FFFFFFFFFFFFFFF
                for f in _forms(word):
                    seen.add((f, context))
                    least[f] = min(context, least.get(f, context))
                before = word
            first.update(least.items())
        pairs = list(seen)
        forms, contexts = pa.array([f for f, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.int64())
        yield pa.RecordBatch.from_arrays([forms, contexts, pa.array([int(x in first) for x in pairs], pa.int32())], ["form", "context", "first"])


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column("text").to_pylist():
            found.update({f for w in set(WORD.findall(text.lower())) for f in _forms(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["form", "n"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems from a bounded sample with columns ``text``, ``y`` and
    ``weight``.  Counts in clean texts are brought to the rate at which toxic
    ones were sampled."""
    weights = {r["y"]: r["w"] for r in sample.groupBy("y").agg(F.max("weight").alias("w")).collect()}
    rate = weights[0] / weights[1]
    toxic, clean = sample.filter("y = 1").select("text").distinct(), sample.filter("y = 0").select("text")
    # The context of least hash stands for a text.
    contexts = toxic.mapInArrow(_contexts, "form string, context long, first int").groupBy("form", "context").agg(F.max("first").alias("first"))
    contexts = contexts.groupBy("form").agg(F.count(F.lit(1)).alias("c"), F.sum("first").alias("texts"))
    positive = materialise(contexts.filter(F.col("c") >= LEAST_CONTEXTS), "lexicon-forms")
    counted = clean.mapInArrow(_counts, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    seen = positive.join(counted, "form", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    in_clean = F.col("n") * rate
    n_clean = max(1, clean.count())
    strong, weak = ((in_clean * ratio <= F.col("c")) & (F.col("n") <= share * n_clean) for ratio, share in (STRONG, WEAK))
    fit = seen.filter(F.col("texts") >= LEAST_TEXTS).filter(strong | weak).withColumn("strong", strong)
    fit = fit.withColumn("w", F.log((F.col("c") + 0.5) / (in_clean * 3 + 0.5)))
    # A stem goes where one longer form has almost all its contexts: the longer one says as much.
    is_stem = F.col("form").endswith("-")
    last = F.least(F.char_length("form") - 1 - is_stem.cast("int"), F.lit(PREFIXES[-1]))
    shorter = F.explode(F.sequence(F.lit(PREFIXES[0]), "last")).alias("k")
    longer = positive.withColumn("last", last).filter(F.col("last") >= PREFIXES[0]).select("form", "c", shorter)
    longer = longer.groupBy(F.concat(F.expr("substring(form, 1, k)"), F.lit("-")).alias("form")).agg(F.max("c").alias("longer"))
    apart = ~is_stem | (F.coalesce("longer", F.lit(0)) < 0.9 * F.col("c"))
    rows = fit.join(longer, "form", "left").filter(apart).orderBy(F.desc("w"), "form").limit(MOST_ENTRIES).collect()
    kept = {r["form"]: "1" if not r["strong"] else "3" if r["w"] > 4 else "2" for r in rows}
    stems = {f[:-1]: symbol for f, symbol in kept.items() if f.endswith("-")}
    covered = lambda word: any(stems.get(word[:n], "") >= kept[word] for n in PREFIXES if len(word) > n)
    return Lexicon({f: symbol for f, symbol in kept.items() if not f.endswith("-") and not covered(f)}, stems)


def _features(lexicon: Lexicon):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            x = [text_features(t, lexicon, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y"), batch.column("weight")], ["x", "y", "weight"])

    return run


#: What the features mean.
SIGNS = [1, 1, 1, 1, 1, -1, -1]
#: Without labels of both classes: the grammar's own weights, towards clean.
DEFAULT_WEIGHTS = [1.0, 1.0, 1.0, 0.5, 1.0, -1.0, -1.0, -3.5]


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A model from at most ``per_class`` training rows of either class, weighted to
    the shares of all labels."""
    arrow_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "toxic", per_class, id_col, text_col)
    if len({r["y"] for r in sample.select("y").distinct().collect()}) < 2:
        return Lexicon(weights=DEFAULT_WEIGHTS)
    lexicon = learn_lexicon(sample)
    rows = sample.select("text", "y", "weight").mapInArrow(_features(lexicon), "x array<double>, y int, weight double").collect()
    rows.sort()  # sums of the fit don't depend on the order of tasks
    y = np.array([r["y"] for r in rows], float)
    lexicon.weights = fit_signed(np.array([r["x"] for r in rows]), y, SIGNS, 0.3, np.array([r["weight"] for r in rows])).tolist()
    return lexicon


def _score(lexicon: Lexicon, threshold: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        w = np.array(lexicon.weights)
        for batch in batches:
            x = np.array([text_features(t, lexicon, memo) for t in batch.column("text").to_pylist()]).reshape(-1, 7)
            p = logistic(x @ w[:-1] + w[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.expm1(x[:, 0]))], ["doc_id", "held_out", "score", "predicted", "clause_weight"])

    return run


def score_toxicity(docs: DataFrame, model: Lexicon, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, clause_weight`` of every row.

    A null text is empty; an empty text, like any without a match, gets the
    score that the fitted intercept gives.  Ids only decide ``held_out`` (a null id counts as
    an empty one) and may be null or repeat.  An empty table gives no rows;
    further columns are ignored.  A very long text is read whole; its clauses are
    parsed one by one, in time and memory that grow with their length."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_score(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int, clause_weight double")
