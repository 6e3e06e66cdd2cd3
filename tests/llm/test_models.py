from itertools import product
from zlib import crc32

import numpy as np
import pytest

from causeway.llm import quality, queries, toxicity
from causeway.llm.labelled import fit_logistic, fit_signed, training_sample
from causeway.llm.quality import LineField


@pytest.fixture(scope="module")
def real(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def accuracy(rows, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    return sum(a == b for a, b in held) / len(held)


def odd_cases(spark, score, odd_docs, no_docs):
    rows = score(odd_docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in odd_docs.collect())
    empty = {r["score"] for r in rows if r["doc_id"] in (3, 4)}
    assert len(empty) == 1 and score(no_docs).collect() == []


def test_quality(spark, real, odd_docs, no_docs):
    docs, labels = real
    model = quality.fit_quality(docs, labels)
    assert accuracy(quality.score_quality(docs, model).collect(), labels, "quality") > 0.95
    odd_cases(spark, lambda d: quality.score_quality(d, model), odd_docs, no_docs)
    junk = [(1, "AAA!! BBB!! CCC!! DDD!! EEE!! FFF!! GGG!! HHH!! III!!\n" * 9), (2, "The line is of a good kind, and so it stays here.\n" + "It was in the house that the other one had for them.")]
    low, high = sorted((r["doc_id"], r["score"]) for r in quality.score_quality(spark.createDataFrame(junk, "doc_id long, text string"), model).collect())
    assert low[1] < 0.3 <= high[1]


def test_labels_and_folds_decide_what_is_learned(spark, real, no_docs):
    docs, labels = real
    none = labels.filter("false")
    assert toxicity.fit_toxicity(docs, none).weights == toxicity.DEFAULT_WEIGHTS
    assert quality.fit_quality(no_docs, labels).unary.tolist() == quality.prior_model().unary.tolist()
    held = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    assert toxicity.fit_toxicity(docs, held).weights == toxicity.DEFAULT_WEIGHTS


def test_chain_against_enumeration():
    rng = np.random.default_rng(3)
    model = LineField(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)), np.zeros(3))
    docs = [(rng.random((n, quality.WIDTH)) < 0.2).astype(np.float32) for n in (1, 2, 5, 7)]
    bad, good, moves = model.marginals(docs)
    for x, p, lp, e in zip(docs, bad, good, moves):
        u = x @ model.unary
        weights, marks, steps = [], [], []
        for y in product((0, 1), repeat=len(x)):
            pairs = list(zip(y, y[1:]))
            weights.append(np.exp(sum(u[i] for i in range(len(y)) if y[i]) + sum(model.moves[a, b] for a, b in pairs)))
            marks.append(y)
            steps.append([[pairs.count((a, b)) for b in (0, 1)] for a in (0, 1)])
        w = np.array(weights) / sum(weights)
        assert np.allclose(p, w @ np.array(marks)) and np.isclose(lp, np.log(w[0]))
        assert np.allclose(e, np.tensordot(w, np.array(steps, float), 1))


def test_slices_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["\n".join(" ".join(rng.choice(["Aa", "b", "C!", "|", "7"], size=rng.integers(1, 9))) for _ in range(n)) for n in (1, 2, 3, 7, 8, 50)]
    model = LineField(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)), np.zeros(3))
    want, good, _ = model.marginals([quality.text_lines(t)[0] for t in texts])
    monkeypatch.setattr(quality, "CHAIN_PLACES", 10)
    for at_once in (1, 2, 3, 7):
        monkeypatch.setattr(quality, "LINES_AT_ONCE", at_once)
        got, again, _ = model.chains([quality.potentials(quality.text_marks(t)[0], model.unary) for t in texts])
        assert np.allclose(good, again) and all(np.allclose(a, b) for a, b in zip(want, got))


def test_quality_of_a_text_of_many_lines(spark):
    """One long text among short ones: padding them to its length would take gigabytes."""
    rows = [(i, "A line of words, as it should be.") for i in range(127)] + [(127, "word\n" * 40_000)]
    found = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), quality.prior_model()).collect()
    assert len(found) == 128 and len({r["score"] for r in found if r["doc_id"] < 127}) == 1


def brute_share(text, model):
    """Length-weighted marginals by dense sums over two states a line."""
    x, lengths = quality.text_lines(text)
    u = x @ model.unary
    front, back = [np.array([1.0, np.exp(u[0])])], [np.ones(2)]
    for v in u[1:]:
        front.append((front[-1] / front[-1].sum() @ np.exp(model.moves)) * [1.0, np.exp(v)])
    for v in u[:0:-1]:
        back.append(np.exp(model.moves) @ (back[-1] / back[-1].sum() * [1.0, np.exp(v)]))
    both = np.array(front) * np.array(back[::-1])
    return float((both[:, 1] / both.sum(axis=1) * lengths).sum() / lengths.sum())


def test_whole_query_of_quality(spark, sf_dir):
    """Each row of the query from the fitted model by other sums."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_quality"](spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        share = min(max(brute_share(r["text"] or "", model), 1e-4), 1 - 1e-4)
        w = model.document
        score = 1 / (1 + np.exp(-(w[0] * np.log(share / (1 - share)) + w[1] * share + w[2])))
        found = got[r["doc_id"]]
        assert abs(found["score"] - score) < 1e-6 and found["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert found["predicted"] == int(found["score"] >= 0.3)


def test_toxicity(spark, real, odd_docs, no_docs):
    docs, labels = real
    model = toxicity.fit_toxicity(docs, labels)
    assert accuracy(toxicity.score_toxicity(docs, model).collect(), labels, "toxic") > 0.95
    odd_cases(spark, lambda d: toxicity.score_toxicity(d, model), odd_docs, no_docs)


def clause(text, lexicon=toxicity.Lexicon()):
    return toxicity.text_features(text, lexicon, {})


def test_grammar_weighs_clauses():
    bare, aimed = clause("What an idiot that was."), clause("You are such an idiot, they know.")
    negated, reported = clause("You are not an idiot."), clause("She said that they were an idiot.")
    assert aimed[0] > bare[0] > 0
    assert negated[0] < aimed[0] and negated[5] == 1
    assert reported[0] < aimed[0] and reported[6] == 1
    threat = clause("I will kill you.")
    assert threat[0] > 0 and threat[4] > 0
    assert clause("They kill time.")[0] == 0 and clause("A fine day for you. It will be.")[0] == 0
    # A negation in another clause changes nothing.
    assert clause("It is not late. You are an idiot.")[5] == 0


def test_grammar_against_enumeration():
    """The best path is the best over all paths."""

    def paths(t, symbols, state=0, weight=0.0):
        if not symbols:
            return [weight] if state in t.final else []
        return [w for s, to, more, _ in t.arcs[state] if s == symbols[0] for w in paths(t, symbols[1:], to, weight + more)]

    for symbols in product("3aYFTO", repeat=4):
        found = paths(toxicity.GRAMMAR, symbols)
        assert np.isclose(toxicity.GRAMMAR.best("".join(symbols))[0], max(found, default=0.0))


def rewritten(symbols, mark, reach, change):
    out = []
    for i, x in enumerate(symbols):
        near = any(symbols[j] == mark for j in range(max(0, i - reach), i))
        out.append(change.get(x, x) if near and x != mark else x)
    return "".join(out)


def test_composition_against_enumeration():
    """The composed transducer's best path is that of the grammar over what the
    negation's and then the report's transducer write."""
    rng = np.random.default_rng(7)
    clauses = ["".join(rng.choice(list("12TYNRFO"), n)) for n in range(1, 24) for _ in range(25)]
    for symbols in [*("".join(p) for p in product("3NRYO", repeat=4)), *clauses]:
        negated = rewritten(symbols, "N", 3, dict(zip("123T", "abct")))
        both = rewritten(negated, "R", 8, dict(zip("123Tabct", "ABCSxyzs")))
        assert np.isclose(toxicity.COMPOSED.best(symbols)[0], toxicity.GRAMMAR.best(both)[0])


def test_compose_adds_weights():
    a = toxicity.Transducer.of("x", 1.0, "y") | toxicity.Transducer.of("x", 5.0, "z")
    both = a.compose(toxicity.Transducer.of("y", 2.0, "out"))
    assert both.best("x") == (3.0, {"out": 1}) and both.best("y")[0] == 0


def test_long_clause():
    """A clause of many insults, without an end, is parsed whole."""
    weight, parts = toxicity.parse_clause("2" * 200_000)
    assert weight == 400_000 and parts == {"insult ": 200_000}


def test_marked_forms_count_for_less(spark, real):
    """After fitting too, negated and reported matches weigh less than plain ones."""
    model = toxicity.fit_toxicity(*real)
    assert all(w * sign >= 0 for w, sign in zip(model.weights, toxicity.SIGNS))
    texts = ["You are an idiot.", "You are not an idiot.", "She said that you are an idiot.", "A fine day."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, negated, reported, clean = (r["score"] for r in toxicity.score_toxicity(docs, model).orderBy("doc_id").collect())
    assert clean < min(negated, reported) and max(negated, reported) < plain


def test_signed_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(size=500) > 0).astype(float)
    assert np.allclose(fit_signed(x, y, [1, -1, 1]), fit_logistic(x, y))
    w = fit_signed(x, y, [1, 1, 1])
    assert w[1] == 0 and np.allclose(w[[0, 2, 3]], fit_logistic(x[:, [0, 2]], y))


def test_weak_stems(spark):
    """Inflected forms of a stem count by the stem; the bare word does not."""
    ends = ["an", "be", "co", "du", "el", "fi", "ga", "ho", "ir", "ju"]
    plain = [f"w{chr(97 + i)} says the day is fine" for i in range(24)]
    bad = [(f"x{chr(97 + i)} grumo{ends[i % 10]} y{chr(97 + i)} grumo{ends[(i + 3) % 10]} the day", 1, 1.0) for i in range(20)]
    rows = [(p, 0, 1.0) for p in plain] + bad
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int, weight double"))
    assert lexicon.symbol("grumokle") in "123" and lexicon.symbol("grumo") == "O"


def test_sampled_classes_keep_their_shares(spark, real):
    """A bound below both classes' sizes leaves the weighted shares those of all labels."""
    docs, labels = real
    n = {r["quality"]: r["count"] for r in labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").groupBy("quality").count().collect()}
    bound = min(n.values()) // 2
    rows = training_sample(docs, labels, "quality", bound).collect()
    for y in (0, 1):
        own = [r["weight"] for r in rows if r["y"] == y]
        assert len(own) == bound and np.isclose(sum(own), n[y])
    assert {r["weight"] for r in training_sample(docs, labels, "quality", 10_000).collect()} == {1.0}
    x, y, w = np.array([[0.0], [1.0], [2.0], [1.5]]), np.array([0.0, 0, 1, 1]), np.array([3, 1, 2, 4])
    assert np.allclose(fit_logistic(x, y, weight=w), fit_logistic(np.repeat(x, w, axis=0), np.repeat(y, w)))


def test_bound_does_not_move_scores(spark):
    """Of 16 equal texts in 20 that are clean, the score says so, whatever the bound."""
    rows = [(i, "Nothing to see here, a fine day.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    for bound in (20, 10_000):
        toxic = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, bound)).first()["score"]
        good = quality.score_quality(docs, quality.fit_quality(docs, labels, bound)).first()["score"]
        assert abs(toxic - 0.2) < 0.06 and abs(good - 0.8) < 0.06


def test_common_words_leave_room_for_rare_insults(spark, monkeypatch):
    """The bound on entries counts what clean texts leave, by weight."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04}")
    plain = [" ".join(f"x{name(100 * i + k)} common{chr(97 + k)}" for k in range(9)) for i in range(24)]
    rows = [(p, 0, 1.0) for p in plain] + [(f"{p} y{name(i)} zorgo" if i < 12 else p, 1, 1.0) for i, p in enumerate(plain)]
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 6)
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int, weight double"))
    assert lexicon.symbol("zorgo") in "23" and lexicon.symbol("commona") == "O"
