"""Byte-level words, and the CRF against a token-by-token run."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tomeforge.llm import crf
from tomeforge.llm.textbytes import slices, windows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ09 .-é漢\n_"), max_size=30)), max_size=8), st.integers(1, 40))
def test_words_are_the_pattern(texts, limit):
    row, by_hash = 0, {}
    for part in slices(pa.array(texts, pa.string()), limit):
        w = words(part)
        assert part.first == row
        row = part.last
        for i in range(part.last - part.first):
            span = range(w.rows[i], w.rows[i + 1])
            got = [w.data[w.start[j] : w.end[j]].tobytes().decode() for j in span]
            assert got == WORD.findall((texts[part.first + i] or "").translate(LOW))
            for j, word in zip(span, got, strict=True):
                assert by_hash.setdefault(int(w.hash[j]), word) == word
        first, h = windows(w, 2)
        assert len(first) == sum(max(0, c - 1) for c in w.counts())
        assert len(h) == len(first)
    assert row == len(texts)


def token_by_token(e, first, t, s):
    marginal, path, edges = [], [], [*np.flatnonzero(first), len(e)]
    for a, b in zip(edges, edges[1:], strict=False):
        x = e[a:b]
        alpha, beta, best, back = [s + x[0]], [np.zeros(len(s))], s + x[0], []
        for i in range(1, len(x)):
            alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + t, axis=0) + x[i])
            scores = best[:, None] + t
            back.append(scores.argmax(axis=0))
            best = scores.max(axis=0) + x[i]
        for i in range(len(x) - 1, 0, -1):
            beta.append(np.logaddexp.reduce(t + (x[i] + beta[-1])[None], axis=1))
        both = np.array(alpha) + np.array(beta[::-1])
        marginal.append(np.exp(both - np.logaddexp.reduce(both, axis=1, keepdims=True)))
        labels = [int(best.argmax())]
        for pointers in reversed(back):
            labels.append(int(pointers[labels[-1]]))
        path += labels[::-1]
    return np.concatenate(marginal), np.array(path)


def test_crf_equals_a_token_by_token_run():
    rng = np.random.default_rng(5)
    for n, size in [(1, 2), (7, 3), (300, 4), (2000, 2)]:
        e, t, s = rng.normal(size=(n, size)) * 3, rng.normal(size=(size, size)), rng.normal(size=size)
        first = rng.random(n) < 0.1
        first[0] = True
        marginal, path = token_by_token(e, first, t, s)
        alpha, beta, _ = crf.forward_backward(e, first, t, s)
        both = alpha * beta
        assert np.abs(both / both.sum(axis=1, keepdims=True) - marginal).max() < 1e-9
        assert (crf.viterbi(e, first, t, s) == path).all()


def test_crf_gradient_learns_transitions():
    rng = np.random.default_rng(1)
    gold = np.repeat(rng.integers(0, 2, 100), 20)
    features = [np.where(rng.random(len(gold)) < 0.8, gold, 1 - gold).astype(np.int32)]
    first = np.zeros(len(gold), bool)
    first[::50] = True
    model = crf.train(features, gold, first, ["a", "b"], 4, epochs=20, batch=200)
    guess = crf.viterbi(model.emissions(features), first, model.moves, model.starts)
    assert (guess == gold).mean() > 0.9 > (features[0] == gold).mean()
