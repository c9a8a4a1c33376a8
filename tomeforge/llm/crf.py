"""Linear-chain conditional random fields over hashed features, vectorised over whole batches.

Many texts are decoded as one long chain in which the first token of each text ignores what came
before. The chain is cut into blocks; the blocks' transfer matrices are multiplied side by side, one
pass over the blocks' edges carries exact states from block to block, and the blocks are then
finished side by side. Results equal those of a token-by-token run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tomeforge.llm.textbytes import Words, mix

U = np.uint64
#: Log-score of a transition that is ruled out.
NEVER = -1e4
#: Tokens of a long text whose features and states are held at once.
WINDOW = 200_000


def slot(value: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Index of a feature's weight: `value` of the given kind, hashed."""
    return (mix(value.astype(U) + U(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - bits)).astype(np.int32)


def affixes(w: Words, longest: int = 3) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """First and last 1..longest bytes of each word as numbers; shorter words give what they have."""
    data = np.concatenate([w.data, np.zeros(longest, np.uint8)]).astype(U)
    size = w.end - w.start
    heads, tails = [], []
    head = np.zeros(len(size), U)
    tail = np.zeros(len(size), U)
    for i in range(longest):
        head = head * U(256) + np.where(size > i, data[w.start + i], 0).astype(U)
        tail = tail * U(256) + np.where(size > i, data[np.maximum(w.end - 1 - i, 0)], 0).astype(U)
        heads.append(head)
        tails.append(tail)
    return heads, tails


def grams(w: Words, n: int, places: int) -> list[np.ndarray]:
    """Byte n-grams at the places 1..places of each word as numbers, 0 beyond its end."""
    data = np.concatenate([w.data, np.zeros(n + places + 1, np.uint8)]).astype(U)
    size = w.end - w.start
    out = []
    for place in range(1, places + 1):
        value = np.zeros(len(size), U)
        for i in range(n):
            value = value * U(256) + data[w.start + place + i]
        out.append(np.where(size >= place + n, value, U(0)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # [2 ** bits, labels]
    moves: np.ndarray  # [labels, labels], from row to column
    starts: np.ndarray  # [labels]
    labels: list[str]
    bits: int

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(features[0]), len(self.labels)), dtype=np.float32)
        for f in features:
            out += self.weights[f]
        return out


def _blocks(n: int) -> tuple[int, int]:
    steps = max(1, min(256, int(n**0.5) // 2))
    return -(-n // steps), steps


def _padded(x: np.ndarray, k: int, s: int, fill) -> np.ndarray:
    out = np.full((k * s, *x.shape[1:]), fill, dtype=x.dtype)
    out[: len(x)] = x
    return out.reshape(k, s, *x.shape[1:])


def forward_backward(emissions: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward states of each token, each summing to 1, and the emissions' potentials.

    first: True at the first token of each text.
    """
    n, size = emissions.shape
    a, start = np.exp(moves), np.exp(starts - starts.max())
    e = np.exp((emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-30
    k, s = _blocks(n)
    eb, fb = _padded(e, k, s, 1.0), _padded(first, k, s, True)
    some = fb.any(axis=0)
    product = np.broadcast_to(np.eye(size), (k, size, size)).copy()
    for t in range(s):
        step = product @ a
        if some[t]:
            at = np.flatnonzero(fb[:, t])
            step[at] = product[at].sum(axis=2, keepdims=True) * start
        step *= eb[:, t, None, :]
        product = step / step.max(axis=(1, 2), keepdims=True)
    into = np.empty((k, size))
    state = np.full(size, 1.0 / size)
    for b in range(k):
        into[b] = state
        state = state @ product[b]
        state /= state.sum()
    alpha = np.empty((k, s, size))
    state = into
    for t in range(s):
        step = state @ a
        if some[t]:
            at = np.flatnonzero(fb[:, t])
            step[at] = start
        step *= eb[:, t]
        state = step / step.sum(axis=1, keepdims=True)
        alpha[:, t] = state
    out_of = np.empty((k, size))
    state = np.full(size, 1.0 / size)
    for b in range(k - 1, -1, -1):
        out_of[b] = state
        state = product[b] @ state
        state /= state.sum()
    beta = np.empty((k, s, size))
    state = out_of
    for t in range(s - 1, -1, -1):
        beta[:, t] = state
        step = (eb[:, t] * state) @ a.T
        if some[t]:
            step[fb[:, t]] = 1.0
        state = step / step.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, size)[:n], beta.reshape(-1, size)[:n], e


def marginals(model: Model, features: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Probability of each label at each token."""
    if not len(first):
        return np.zeros((0, len(model.labels)))
    alpha, beta, _ = forward_backward(model.emissions(features), first, model.moves, model.starts)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def long_marginals(model: Model, features, w: Words, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """marginals() of features(w), where features look two words back and ahead at most, by windows of tokens.

    One pass carries the forward state from window to window, one comes back with the backward state, so
    that features and states of one window are held at a time, whatever the length of the text.
    """
    n = len(w.hash)
    if n <= window:
        return marginals(model, features(w), first)
    a, start = np.exp(model.moves), model.starts - model.starts.max()

    def emissions(x: int, y: int) -> np.ndarray:
        low, high = max(0, x - 2), min(n, y + 2)
        zero = w.start[low]
        part = Words(w.data[zero : w.end[high - 1]], w.start[low:high] - zero, w.end[low:high] - zero, w.hash[low:high], np.array([0, high - low]))
        return model.emissions([f[x - low : y - low] for f in features(part)]).astype(np.float64)

    def run(x: int, y: int, into: np.ndarray, behind: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the window, its last forward state, and what the window before has behind it."""
        e, head = emissions(x, y), first[x:y].copy()
        own = np.exp(e[0] - e[0].max())
        if not head[0]:  # as if a text began here, from the state that comes in
            e[0] += np.log(into @ a + 1e-300) - start
            head[0] = True
        if behind is not None:
            e[-1] += np.log(behind + 1e-300)
        alpha, beta, _ = forward_backward(e, head, model.moves, model.starts)
        before = None if first[x] else a @ (own * beta[0] * (behind if behind is not None and y - x == 1 else 1.0))
        both = alpha * beta
        return both / both.sum(axis=1, keepdims=True), alpha[-1], before if before is None else before / before.sum()

    edges = [*range(0, n, window), n]
    pieces = list(zip(edges, edges[1:], strict=False))
    states = [np.full(len(model.labels), 1.0 / len(model.labels))]
    for x, y in pieces[:-1]:
        states.append(run(x, y, states[-1], None)[1])
    out, behind = np.empty((n, len(model.labels))), None
    for (x, y), into in zip(reversed(pieces), reversed(states), strict=True):
        out[x:y], _, behind = run(x, y, into, behind)
    return out


def viterbi(emissions: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The best label sequence; of equal ones, that with smaller labels at the later tokens."""
    n, size = emissions.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    k, s = _blocks(n)
    eb, fb = _padded(emissions.astype(np.float64), k, s, 0.0), _padded(first, k, s, True)
    step_of = lambda t: np.where(fb[:, t, None, None], starts[None, None, :], moves[None])  # noqa: E731  [k, from, to]
    product = np.full((k, size, size), NEVER * 100.0)
    product[:, np.arange(size), np.arange(size)] = 0
    for t in range(s):
        product = (product[:, :, :, None] + step_of(t)[:, None]).max(axis=2) + eb[:, t, None, :]
    into = np.empty((k, size))
    state = np.zeros(size)
    for b in range(k):
        into[b] = state
        state = (state[:, None] + product[b]).max(axis=0)
        state = state - state.max()
    back = np.empty((s, k, size), dtype=np.int8)
    state = into
    for t in range(s):
        scores = state[:, :, None] + step_of(t)
        back[t] = scores.argmax(axis=1)
        state = scores.max(axis=1) + eb[:, t]
    to_start = np.broadcast_to(np.arange(size), (k, size))
    for t in range(s - 1, -1, -1):
        to_start = np.take_along_axis(back[t], to_start, axis=1)
    ends = np.empty(k, dtype=np.int64)
    label = int(state[-1].argmax())
    for b in range(k - 1, -1, -1):
        ends[b] = label
        label = int(to_start[b, label])
    out = np.empty((k, s), dtype=np.int64)
    for t in range(s - 1, -1, -1):
        out[:, t] = ends
        ends = back[t][np.arange(k), ends].astype(np.int64)
    return out.reshape(-1)[:n]


def train(features: list[np.ndarray], gold: np.ndarray, first: np.ndarray, labels: list[str], bits: int, *, epochs: int = 3, batch: int = 20_000, rate: float = 0.2, decay: float = 1e-6, banned: list[tuple[int, int]] = (), banned_starts: list[int] = (), seed: int = 7) -> Model:
    """Maximum likelihood by AdaGrad over batches of whole sequences; banned moves keep NEVER."""
    size, rng = len(labels), np.random.default_rng(seed)
    model = Model(np.zeros((1 << bits, size), np.float32), np.zeros((size, size)), np.zeros(size), labels, bits)
    for i, j in banned:
        model.moves[i, j] = NEVER
    for i in banned_starts:
        model.starts[i] = NEVER
    free, free_starts = model.moves > NEVER, model.starts > NEVER
    seen = [np.full(x.shape, 1e-2, x.dtype) for x in (model.weights, model.moves, model.starts)]
    edges = np.append(np.flatnonzero(first), len(first))
    cuts = [0]
    for i in range(1, len(edges)):
        if edges[i] - edges[cuts[-1]] >= batch or i == len(edges) - 1:
            cuts.append(i)
    chunks = [slice(edges[a], edges[b]) for a, b in zip(cuts, cuts[1:], strict=False) if edges[b] > edges[a]]
    for _ in range(epochs):
        for c in rng.permutation(len(chunks)):
            own = chunks[c]
            f, y, head = [x[own] for x in features], gold[own], first[own]
            alpha, beta, e = forward_backward(model.emissions(f), head, model.moves, model.starts)
            both = alpha * beta
            miss = both / both.sum(axis=1, keepdims=True)
            inner = np.flatnonzero(~head)
            a = np.exp(model.moves)
            come = e[inner] * beta[inner]
            come /= ((alpha[inner - 1] @ a) * come).sum(axis=1, keepdims=True)
            pairs = (alpha[inner - 1].T @ come) * a
            np.subtract.at(pairs, (y[inner - 1], y[inner]), 1.0)
            miss[np.arange(len(y)), y] -= 1.0
            starts = miss[head].sum(axis=0)
            scale = 1.0 / len(y) ** 0.5
            grad = np.empty_like(model.weights)
            for label in range(size):
                total = np.zeros(1 << bits)
                for x in f:
                    total += np.bincount(x, weights=miss[:, label], minlength=1 << bits)
                grad[:, label] = total * scale
            for x, g, past, held in ((model.weights, grad, seen[0], True), (model.moves, pairs * scale * free, seen[1], free), (model.starts, starts * scale * free_starts, seen[2], free_starts)):
                past += g * g
                x -= (rate * g / np.sqrt(past)).astype(x.dtype)
                if held is True:
                    x *= 1 - decay
    return model
