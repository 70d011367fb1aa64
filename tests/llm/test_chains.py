"""Toxicity: a text is one chain, wherever its rows of SEGMENT tokens begin."""

import numpy as np
import pandas as pd
import pytest

from tessera.llm import toxicity


def one_chain(unary, between):
    """Marginals, expected transitions and log partition of one whole chain, in logarithms."""
    n = len(unary)
    u = np.stack([np.zeros(n), unary], axis=1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = u[0]
    for k in range(1, n):
        a[k] = np.logaddexp(*(a[k - 1][:, None] + between)) + u[k]
    for k in range(n - 2, -1, -1):
        b[k] = np.logaddexp(*(between + u[k + 1] + b[k + 1]).T)
    z = np.logaddexp(*a[-1])
    pairs = sum((np.exp(a[k - 1][:, None] + between + u[k] + b[k] - z) for k in range(1, n)), np.zeros((2, 2)))
    return np.exp(a + b - z)[:, 1], pairs, z


@pytest.mark.parametrize("strength", [1.0, 8.0])
def test_marginals_cross_the_borders_of_rows(strength):
    rng = np.random.default_rng(4)
    lengths = [0, 1, 63, 64, 65, 128, 129, 700, 0, 5]
    codes = [np.arange(n) + 1000 * i for i, n in enumerate(lengths)]
    scores = rng.normal(0, strength, 20_000)
    between = rng.normal(0, strength, (2, 2)) + np.eye(2) * strength
    rows, owner = toxicity.segments(codes)
    live = rows >= 0
    p, pairs, logz = toxicity.marginals(np.where(live, scores[np.maximum(rows, 0)], 0), live, between, toxicity.continued(owner))
    want = [one_chain(scores[c], between) for c in codes if len(c)]
    assert np.allclose(p[live], np.concatenate([w[0] for w in want]), atol=1e-9)
    assert np.allclose(pairs, sum(w[1] for w in want)) and np.isclose(logz.sum(), sum(w[2] for w in want))
    empty = toxicity.marginals(np.zeros((0, 64)), np.zeros((0, 64), bool), between, toxicity.continued(owner[:0]))
    assert empty[0].shape == (0, 64)


def test_objective_is_of_whole_chains():
    rng = np.random.default_rng(5)
    codes = [rng.integers(0, 6, n) for n in (3, 64, 200, 0)]
    tags = [rng.integers(0, 2, len(c)) for c in codes]
    unary, between = rng.normal(size=6), rng.normal(size=(2, 2))
    batch = pd.DataFrame({"codes": codes, "tags": tags})
    want = sum((unary[c] * t).sum() + between[t[:-1], t[1:]].sum() - one_chain(unary[c], between)[2] for c, t in zip(codes, tags) if len(c))
    got = toxicity._objective([batch], unary, between)
    assert np.isclose(got[0], want)
    for i in range(4):
        step = np.zeros(4)
        step[i] = 1e-5
        up, down = (toxicity._objective([batch], unary, between + s * step.reshape(2, 2))[0] for s in (1, -1))
        assert np.isclose(got[7 + i], (up - down) / 2e-5, atol=1e-4)


def test_spans_do_not_depend_on_the_offset():
    model = toxicity.Field(lexicon={"vile": 5}, codes=toxicity.all_codes())
    model.unary = np.array([4.0 if t[0] else -2.0 for t in model.codes])
    model.between, model.curve = np.array([[1.5, -1.5], [-1.5, 1.5]]), np.zeros(5)
    tagger = toxicity.Tagger(model)
    for before in range(56, 66):
        text = "calm " * before + "vile mild vile vile mild vile " + "calm " * 40
        (_, (spans,)) = tagger.tag([text])
        assert spans == [{"start": 5 * before, "end": 5 * before + 29}]
