"""Operator 6: held-out accuracy, what is located, what is never an input, edges."""

import random
from zlib import crc32

import numpy as np
import pytest

from teachspark.llm import toxicity
from teachspark.llm.toxicity import Model, fit_noisy_or, held_out, pack, score_documents, sentence_features, train

STEMS = ["vilek", "gromp", "skaz"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [a + b + c for a in "ta re lo mi su".split() for b in "na ke po ri".split() for c in "st l m nd".split()]
    rows, labels = [], []
    for i in range(1500):
        sentences = [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(rng.randint(2, 8))]
        toxic = rng.random() < 0.15
        if toxic:
            at = rng.randrange(len(sentences))
            for _ in range(rng.randint(1, 3)):
                sentences[at] += " " + rng.choice(STEMS) + rng.choice(["", "a", "est", "ung", "ing"])
        rows.append((i, ". ".join(sentences).capitalize() + ".", toxic))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth boolean").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int").cache()


def test_held_out_accuracy_and_sentences(corpus):
    docs, labels = corpus
    rows = score_documents(docs, train(docs, labels)).withColumn("held", held_out("doc_id")).collect()
    held = [r for r in rows if r.held]
    assert all(r.held == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 250
    right = sum((r.toxicity.predicted == 1) == r.truth for r in held)
    assert right / len(held) > 0.97
    for r in held:
        if r.truth and r.toxicity.predicted:
            assert any(s in r.text[o.start : o.stop].lower() for o in r.toxicity.offending for s in STEMS)
        for o in r.toxicity.offending:
            assert 0.25 <= o.probability <= 1 and "." not in r.text[o.start : o.stop]


def test_held_out_labels_change_nothing(corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", held_out("doc_id").cast("int") * (1 - labels.toxic) + (~held_out("doc_id")).cast("int") * labels.toxic)
    a, b = train(docs, labels), train(docs, flipped)
    assert a.lexicon == b.lexicon and (a.weights == b.weights).all() and a.bias == b.bias
    assert train(docs.repartition(7), labels.repartition(3)).bias == pytest.approx(a.bias, abs=1e-9)
    assert len(train(docs, labels, sample=200).lexicon) <= len(a.lexicon)


def test_edges(spark, corpus, edge_docs, no_docs):
    docs, labels = corpus
    model = train(docs, labels)
    out = score_documents(edge_docs, model).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.toxicity.score <= 1 for r in out)
    assert all(r.toxicity.score == 0 for r in out if not (r.text or "").strip())
    assert score_documents(no_docs, model).count() == 0
    for bad in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        empty = train(docs, bad)
        assert empty.lexicon == {} and empty.score("vilek gromp. skaz")[0] == 0
    assert Model().score(None) == (0.0, [])
    assert sentence_features("İx vilek. a", {"vilek": 0}, {})[1][0][2] == [0]


def plain_fit(counts, bags, labels, prior):
    """The fit by its definition, with a loop over documents and sentences."""
    theta = np.append(prior, np.log(np.clip(labels.mean(), 1e-4, 1 - 1e-4) / max(1.0, sum(max(n, len(b)) for n, b in zip(counts, bags, strict=True)) / len(bags))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, toxicity.STEPS + 1):
        grad = np.zeros_like(theta)
        for n, bag, toxic in zip(counts, bags, labels, strict=True):
            rows = [*bag, *[[]] * (n - len(bag))]
            z = [theta[-1] + sum(theta[i] for i in ids) for ids in rows]
            total = max(1e-9, sum(np.logaddexp(0, x) for x in z))
            pull = -1 / np.expm1(min(total, 50)) if toxic else 1.0
            for ids, x in zip(rows, z, strict=True):
                for i in (*ids, -1):
                    grad[i] += pull / (1 + np.exp(-x)) / len(bags)
        grad[:-1] += toxicity.DECAY * (theta[:-1] - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_fit_in_pieces_equals_the_definition(monkeypatch, piece):
    rng = random.Random(2)
    bags = [[sorted(rng.sample(range(6), rng.randint(1, 4))) for _ in range(rng.randint(0, 4))] for _ in range(30)]
    counts, labels = [len(b) + rng.randint(0, 3) for b in bags], np.array([any(0 in ids for ids in b) or rng.random() < 0.1 for b in bags])
    assert sorted(bags) == sorted(bags, key=pack) and pack([]) == b""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity, "STEPS", 40)
    prior = np.linspace(-0.5, 1.5, 6)
    weights, bias = fit_noisy_or(counts, [pack(b) for b in bags], labels, prior)
    assert np.allclose([*weights, bias], plain_fit(counts, bags, labels, prior), atol=1e-9)
    assert np.isfinite(fit_noisy_or([3, 0], [b"", b""], np.array([True, False]), np.zeros(0))[1])


def test_what_reaches_the_driver_is_a_few_bytes_a_word(spark, corpus, monkeypatch):
    """Long texts: nothing but packed words comes to the driver, however many sentences a text has."""
    docs, labels = corpus
    long = docs.selectExpr("doc_id", "repeat(text, 40) as text")
    got = []
    fit = toxicity.fit_noisy_or
    monkeypatch.setattr(toxicity, "STEPS", 2)
    monkeypatch.setattr(toxicity, "fit_noisy_or", lambda *a: got.append(a) or fit(*a))
    model = train(long, labels)
    counts, bags = got[0][:2]
    assert model.lexicon and sum(counts) > 100_000 and all(isinstance(b, bytes | bytearray) for b in bags)
    words = sum((np.frombuffer(b, ">u2") > 0).sum() for b in bags)
    assert sum(map(len, bags)) <= 4 * words


def test_grades_count_as_two_classes(corpus):
    """Labels of several grades: each class is counted whole, so the likelihood ratios have their right totals."""
    docs, labels = corpus
    graded = labels.selectExpr("doc_id", "case when toxic = 1 then 1 + doc_id % 3 else -(doc_id % 2) end as toxic")
    a, b = train(docs, labels), train(docs, graded)
    assert a.lexicon == b.lexicon and len(a.lexicon) and np.allclose([*a.weights, a.bias], [*b.weights, b.bias], atol=1e-9)
