"""The chain on planted categories, held out; its parts on awkward input."""

import random

import numpy as np
import pytest

from commentguard.llm.toxicity import SLOTS, Matrix, distinct_words, fit_chain, fit_toxicity, predict_toxicity, slots_of

CATEGORIES = ["insult", "threat"]


def planted(n, seed):
    """A threat hangs on its own words or, twice as weakly, on an insult beside a vague word."""
    rng = random.Random(seed)
    vocabulary = [f"word{k}x" for k in range(400)]
    out = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(20, 120))
        insult, threat = rng.random() < 0.25, rng.random() < 0.1
        if insult:
            words[rng.randrange(len(words))] = rng.choice(["moronic", "idiotic", "scummy"])
        if threat:
            words[rng.randrange(len(words))] = rng.choice(["killing", "burning"])
        vague = rng.random() < 0.3
        if vague:
            words[rng.randrange(len(words))] = "tonight"
        out.append((k, " ".join(words), int(insult), int(threat or (insult and vague))))
    return out


@pytest.fixture(scope="module")
def chain(spark):
    rows = planted(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, insult int, threat int")
    return fit_toxicity(docs, labels, CATEGORIES)


def test_held_out_rows(spark, chain):
    rows = planted(600, 2)
    docs = spark.createDataFrame([(*r[:2], 0.5) for r in rows], "doc_id long, text string, p_insult double")
    got = {r.doc_id: r for r in predict_toxicity(docs, chain).collect()}
    for k, name in enumerate(CATEGORIES):
        truth, found = [r[2 + k] == 1 for r in rows], [got[r[0]][f"is_{name}"] for r in rows]
        hits = sum(a and b for a, b in zip(truth, found, strict=True))
        assert hits >= 0.9 * sum(truth) * (1 if k == 0 else 0.8) and hits >= 0.85 * sum(found)
    assert all(0 <= got[r[0]].p_threat <= 1 for r in rows)


def test_later_models_see_earlier_probabilities(chain):
    assert [len(m.earlier) for m in chain.models] == [0, 1] and chain.models[1].earlier[0] > 0


def test_prediction_equals_the_matrix_form(spark, chain):
    rows = planted(40, 3)
    x = Matrix([np.array([s for w in distinct_words(t) for s in slots_of(w)]) for _, t, _, _ in rows])
    first = chain.models[0].probabilities(x, np.zeros((x.n, 0)))
    second = chain.models[1].probabilities(x, first[:, None])
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in predict_toxicity(docs, chain).collect()}
    for k in range(len(rows)):
        assert abs(got[k].p_insult - first[k]) < 1e-4 and abs(got[k].p_threat - second[k]) < 1e-4


def test_nulls_and_empty_tables(spark, chain):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "12 !"), (2, "moronic " * 20_000)], "doc_id long, text string")
    got = predict_toxicity(docs, chain).collect()
    assert [r.is_insult for r in got] == [False, False, False, True]
    labels = spark.createDataFrame([], "doc_id long, insult int, threat int")
    untrained = fit_toxicity(docs, labels, CATEGORIES)
    assert not any(r.is_insult or r.is_threat for r in predict_toxicity(docs, untrained).collect())
    assert predict_toxicity(docs.limit(0), chain).collect() == []


def test_one_class_only():
    rows = [np.array(slots_of("a")), np.array(slots_of("b"))] * 4
    chain = fit_chain(rows, np.zeros((8, 1), int), ["never"])
    assert chain.thresholds == [0.5] and not chain.models[0].weights.any() and len(chain.models[0].weights) == SLOTS
