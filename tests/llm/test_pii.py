"""Labels of the field reach every occurrence of a key, and messages are those of plain loopy message passing."""

import itertools

import numpy as np

from terrafolio.llm import pii

PHONE = pii.KINDS.index("phone")


def model(**changed):
    return pii.PiiModel(np.zeros((pii.N_SHAPE, pii.N_LABELS)), np.zeros((pii.N_LABELS, pii.N_LABELS)), 8.0 * np.diag([1.0] * pii.NONE + [0.0]), pii.PiiParams(**changed))


def test_a_label_reaches_every_occurrence():
    for n in (20, 3000):
        text = "+15551234567" + " and so on 15551234567" * n
        base = [pii.base_spans(text)]
        assert len(base[0]) == 1
        added = pii.added_spans(model(), [text], base)[0][0]
        assert added == [(PHONE, m, m + 11) for m in (12 + 11 + 22 * i for i in range(n))]


def test_marginals_are_exact_without_loops():
    # one key three times, too far apart for its tokens to be neighbours
    rng = np.random.default_rng(5)
    half = lambda: rng.normal(size=(pii.N_LABELS, pii.N_LABELS))
    a, b = half(), half()
    m = pii.PiiModel(rng.normal(size=(pii.N_SHAPE, pii.N_LABELS)), a + a.T, b + b.T, pii.PiiParams())
    field = pii.Field(["1234567 x y z 1234567"], [[]])
    unary = field.shape @ m.unary + field.border[:, None] * m.chain[pii.NONE]
    total = np.zeros((field.n, pii.N_LABELS))
    for labels in itertools.product(range(pii.N_LABELS), repeat=field.n):
        z = sum(unary[i, l] for i, l in enumerate(labels)) + sum(m.chain[labels[i], labels[j]] for i, j in field.chain) + sum(m.skip[labels[i], labels[j]] for i, j in field.skip)
        for i, l in enumerate(labels):
            total[i, l] += np.exp(z)
    np.testing.assert_allclose(pii.marginals(m, field)[0], total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_a_document_does_not_depend_on_those_beside_it():
    texts = ["+15551234567 or 15551234567 or 15551234567", "call 1234567 x 1234567", "", "+4930123456 1234567 30123456 4930123456"]
    base = [pii.base_spans(t) for t in texts]
    rng = np.random.default_rng(1)
    m = pii.PiiModel(rng.normal(size=(pii.N_SHAPE, pii.N_LABELS)), model().chain, model().skip, pii.PiiParams())
    together = pii.marginals(m, pii.Field(texts, base))[0]
    alone = np.concatenate([pii.marginals(m, pii.Field([t], [b]))[0] for t, b in zip(texts, base)])
    np.testing.assert_array_equal(together, alone)
