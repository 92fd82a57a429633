"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Words are numbers: 0 is the end of a text, 1 to SIZE - 1 frequent words in order of rank, SIZE any other word. Words of
like rank form classes of equal size; a word's probability is its class's times its own within the class. All other words are one
more class. Biases start at smoothed counts, so an untrained model is a unigram model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

HIDDEN, CLASSES, MEMBERS = 32, 64, 64
SIZE = CLASSES * MEMBERS
#: Stretches of text side by side and words in a window of truncated backpropagation, for few and for many words; times that few words are read.
FEW, MANY, PASSES = (128, 20), (256, 32), 3
#: Words from which on they are many.
MANY_WORDS = 1_000_000
RATE, WARM_UP = 0.012, 20
#: Rows worked on at once, so that they stay near the processor; states between two looks at the output layer when scoring.
ROWS, LOOK = 1024, 32_768
#: Weights that a step of learning works on at once.
PART = 1 << 14
#: Times in a window from which on a word is frequent.
OFTEN = 12
#: Texts side by side when scoring.
ABREAST = 512
UNUSED = -1e4


@dataclass
class Weights:
    gates: np.ndarray  # (SIZE + 1, 3 HIDDEN): what each word adds to reset, keep and new state
    turn: np.ndarray  # (HIDDEN, 3 HIDDEN)
    of_class: np.ndarray  # (HIDDEN, CLASSES + 1)
    class_bias: np.ndarray
    member: np.ndarray  # (CLASSES, HIDDEN, MEMBERS)
    member_bias: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.all()])


SHAPES = [(SIZE + 1, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES + 1), (CLASSES + 1,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS)]
N_WEIGHTS = sum(math.prod(x) for x in SHAPES)


def shaped(flat: np.ndarray) -> Weights:
    """Weights as views of one array, in the order of flat()."""
    ends = np.cumsum([math.prod(x) for x in SHAPES])
    return Weights(*(part.reshape(x) for part, x in zip(np.split(flat, ends[:-1]), SHAPES)))


def fresh(counts: np.ndarray, rest: int, seed: int = 5) -> Weights:
    """Weights before training. counts: of the words 0 to len - 1 (at most SIZE); rest: of all other words together."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    smooth = np.zeros(SIZE)
    smooth[: len(counts)] = counts + 1.0
    members = smooth.reshape(CLASSES, MEMBERS)
    mass = np.append(members.sum(1), rest + 1.0)
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-9)), UNUSED).astype(np.float32)
    within = np.where(members.sum(1, keepdims=True) > 0, members, 1.0)  # an unused class needs some distribution
    gates = small(SIZE + 1, 3 * HIDDEN)
    gates[:, HIDDEN : 2 * HIDDEN] += 1  # states last, to begin with
    return Weights(gates, small(HIDDEN, 3 * HIDDEN), small(HIDDEN, CLASSES + 1), log(mass / mass.sum()), small(CLASSES, HIDDEN, MEMBERS), log(within / within.sum(1, keepdims=True)))


class Room:
    """Arrays by name that are used again, as pages of new large arrays cost the system time. What one holds lasts until its name is asked for again."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, np.dtype], np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size, key = math.prod(shape), (name, np.dtype(dtype))
        if key not in self.held or self.held[key].size < size:
            self.held[key] = np.empty(size, dtype)
        return self.held[key][:size].reshape(shape)


#: Of this process: a task works in one thread.
ROOM = Room()


def by_gate(x: np.ndarray) -> np.ndarray:
    """(3, rows, HIDDEN) of (rows, 3 HIDDEN): each gate's part in one piece, as numpy is slow on parts of rows; times what exp takes it with in step()."""
    return np.multiply(x.reshape(-1, 3, HIDDEN).transpose(1, 0, 2), np.array([-1, 1, -2], x.dtype)[:, None, None], order="C")


def step(gates: np.ndarray, turn: np.ndarray, h: np.ndarray, word: np.ndarray, a: np.ndarray, u: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """forward() of weights that by_gate() has put apart. a, (3, streams, HIDDEN), and u, (streams, HIDDEN), are written over and hold what backpropagation needs."""
    gates.take(word, axis=1, out=a, mode="clip")  # no word is out of range; with another mode numpy copies a first
    both, new = a[:2], a[2]
    both += np.matmul(h, turn[:2])
    np.matmul(h, turn[2], out=u)
    np.exp(both, out=both)
    both += 1
    np.reciprocal(both, out=both)
    reset, change = both  # change: 1 - keep
    moved = reset * u
    new += moved
    # tanh(x) = 2 / (1 + exp(-2 x)) - 1: numpy's exp is faster
    np.exp(new, out=new)
    new += 1
    np.divide(2, new, out=new)
    new -= 1
    np.subtract(new, h, out=moved)
    moved *= change
    return np.add(moved, h, out=moved if out is None else out), (reset, change, new, u)


def backward(turned: tuple[np.ndarray, np.ndarray], saved: tuple, after: np.ndarray, before: np.ndarray, dh: np.ndarray, d_gates: np.ndarray, g_turn: np.ndarray) -> np.ndarray:
    """Writes the gradients of what a step adds to the gates, adds those of the turn; gives the gradient of the state before it.

    after: the state after the step; where dh is 0 any other does as well.
    """
    reset, change, new, u = saved
    slope = dh * change
    back = dh - slope
    x = after - new
    np.multiply(x, slope, out=d_gates[:, HIDDEN : 2 * HIDDEN])
    np.multiply(new, new, out=x)
    np.subtract(1, x, out=x)
    slope *= x
    d_gates[:, 2 * HIDDEN :] = slope
    d_new = slope * reset  # of what the state adds to the new state
    np.subtract(reset, 1, out=x)
    x *= u  # -2 times what the state adds
    x *= 0.5
    x *= d_new
    d_gates[:, :HIDDEN] = x
    back += d_gates[:, : 2 * HIDDEN] @ turned[0]
    back += d_new @ turned[1]
    g_turn[:, : 2 * HIDDEN] += before.T @ d_gates[:, : 2 * HIDDEN]
    g_turn[:, 2 * HIDDEN :] += before.T @ d_new
    return back


def forward(w: Weights, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state after a word, and what backpropagation needs."""
    a = np.empty((3, *h.shape), h.dtype)
    return step(by_gate(w.gates).astype(h.dtype), by_gate(w.turn).astype(h.dtype), h, word, a, np.empty_like(h))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def within_reach(weight: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exp neither overflows nor vanishes for what these weights make of states (within -1 and 1) in its likeliest column."""
    return float((np.abs(weight).sum(-2).max(-1) + np.abs(bias.max(-1))).max()) < 80


def chosen(x: np.ndarray, own: np.ndarray, slope: float, shift: bool) -> np.ndarray:
    """Each row's log-probability of its own column under softmax; x is used up, unless slope is 0 it becomes slope times the gradient of the loss."""
    if shift:
        x -= x.max(1, keepdims=True)
    place = np.arange(0, x.size, x.shape[1])
    place += own
    told = x.take(place)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    told -= np.log(total)
    if slope:
        x *= (slope / total)[:, None]
        x.reshape(-1)[place] -= slope
    return told


def with_bias(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias as one more row of the weights, for states that end in 1."""
    return np.concatenate([weight, bias[..., None, :]], -2)


def output(w: Weights, h: np.ndarray, word: np.ndarray, g: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of the words after states h; with g, the gradients of the mean loss are added and the states' are given."""
    n = len(word)
    kind = (word // MEMBERS).astype(np.uint8)  # SIZE // MEMBERS is the class of all other words
    slope = 1 / max(1, n) if g is not None else 0.0
    room = lambda name, *shape: ROOM(name, shape, h.dtype)
    told = np.empty(n)
    dh = room("dh", n, HIDDEN) if slope else None
    of_class, member = with_bias(w.of_class, w.class_bias), with_bias(w.member, w.member_bias)
    turned = np.ascontiguousarray(w.of_class.T)
    shift, shift_within = not within_reach(w.of_class, w.class_bias), not within_reach(w.member, w.member_bias)
    full = room("full", n, HIDDEN + 1)
    full[:, :HIDDEN] = h
    full[:, HIDDEN] = 1
    for k in range(0, n, ROWS):
        at = slice(k, k + ROWS)
        some = full[at]
        x = np.matmul(some, of_class, out=room("x", len(some), CLASSES + 1))
        told[at] = chosen(x, kind[at], slope, shift)
        if slope:
            d = some.T @ x
            g.of_class += d[:HIDDEN]
            g.class_bias += d[HIDDEN]
            np.matmul(x, turned, out=dh[at])
    # by class, so that each class's states are one piece
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    back = np.empty_like(order)
    back[order] = np.arange(n)
    order = order[: edges[-1]]
    full, own = full.take(order, axis=0, out=room("by_class", len(order), HIDDEN + 1), mode="clip"), (word % MEMBERS).take(order)
    within, d_within = np.zeros(n), room("d_within", n, HIDDEN) if slope else None
    if slope:
        d_within[len(order) :] = 0
    for c in np.flatnonzero(np.diff(edges)).tolist():
        for k in range(edges[c], edges[c + 1], ROWS):
            at = slice(k, min(k + ROWS, edges[c + 1]))
            some = full[at]
            x = np.matmul(some, member[c], out=room("x", len(some), MEMBERS))
            within[at] = chosen(x, own[at], slope, shift_within)
            if slope:
                d = some.T @ x
                g.member[c] += d[:HIDDEN]
                g.member_bias[c] += d[HIDDEN]
                np.matmul(x, w.member[c].T, out=d_within[at])
    told += within.take(back)
    if slope:
        dh += d_within.take(back, axis=0, out=room("full", n, HIDDEN), mode="clip")
    return told, dh


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of the rows to the row of `to` that `at` names: rows of frequent places by their sums, others by their first, second ... time."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    place, rows = at[order], rows.take(order, axis=0, out=ROOM("sorted", rows.shape, rows.dtype), mode="clip")
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    often = np.diff(starts, append=len(place))
    for k in np.flatnonzero(often > OFTEN):
        to[place[starts[k]]] += rows[starts[k] : starts[k] + often[k]].sum(0)
    starts, often = starts[often <= OFTEN], often[often <= OFTEN]
    for time in range(OFTEN):
        own = starts[often > time] + time
        to[place[own]] += rows.take(own, axis=0)


def gradients(w: Weights, h: np.ndarray, words: np.ndarray, first: np.ndarray, g: Weights | None = None) -> tuple[float, Weights, np.ndarray]:
    """(mean loss, gradients, state after) of a window of words (steps, streams); first: which of them begin a text. g: zeros to add to."""
    g = g or shaped(np.zeros(N_WEIGHTS, w.gates.dtype))
    gates, turn = by_gate(w.gates), by_gate(w.turn)
    room = lambda name, *shape: ROOM(name, shape, h.dtype)
    a, u, states = room("a", len(words), 3, *h.shape), room("u", len(words), *h.shape), room("states", len(words) + 1, *h.shape)
    states[0] = h
    saved = []
    for t, (word, begins) in enumerate(zip(words, first)):
        states[t][begins] = 0
        saved.append(step(gates, turn, states[t], word, a[t], u[t], states[t + 1])[1])
    said = words.ravel()
    told, dh = output(w, states[:-1].reshape(-1, HIDDEN), said, g)
    dh = dh.reshape(states[:-1].shape)
    d_gates = room("d_gates", *words.shape, 3 * HIDDEN)
    turned = tuple(np.ascontiguousarray(x.T) for x in np.split(w.turn, [2 * HIDDEN], 1))
    back = np.zeros_like(h)
    for t in range(len(words) - 1, -1, -1):
        # back is the gradient of the state after step t; a text's first state is fixed
        back = backward(turned, saved[t], states[t + 1], states[t], back, d_gates[t], g.turn)
        back += dh[t]
        back[first[t]] = 0
    d_gates = d_gates.reshape(-1, 3 * HIDDEN)
    add_rows(g.gates, said, d_gates)
    return float(-told.mean()), g, states[-1].copy()


def adam(flat: np.ndarray, m: np.ndarray, v: np.ndarray, slopes: np.ndarray, room: np.ndarray, scale: float, rate: float, least: float) -> None:
    """A step of Adam with decays of 0.9 and 0.99. scale: a tenth of what the gradients are multiplied by; rate and least carry both corrections of bias."""
    np.multiply(slopes, scale, out=room)
    m *= 0.9
    m += room
    room *= room
    v *= 0.99
    v += room
    np.sqrt(v, out=room)
    room += least
    np.divide(m, room, out=room)
    room *= rate
    flat -= room


def learn(w: Weights, texts: list[np.ndarray], passes: int = 1, span: tuple[float, float] = (0.0, 1.0), windows: int | None = None, seed: int = 5) -> Weights:
    """Weights after reading each text (an array of numbers, with its end) `passes` times, by Adam.

    The texts of a pass stand one after the other in shuffled order and are cut into stretches of equal length, which are read side
    by side; a stretch that begins within a text has no state there. Where stretches don't come out even, first words are read again.
    span: the part of the whole training that this is, for the rate. windows: at most so many (all by default).
    """
    n = sum(map(len, texts))
    if not n:
        return w
    streams, window = MANY if n >= MANY_WORDS else FEW
    streams = max(1, min(streams, n // window))
    length = -(-n // streams)
    each = -(-length // window)
    windows = min(windows or passes * each, passes * each)
    rng = np.random.default_rng(seed)
    flat = w.flat()
    w, m, v, slopes = shaped(flat), *(np.zeros_like(flat) for _ in range(3))
    g, room = shaped(slopes), np.empty(PART, flat.dtype)
    parts = [tuple(x[k : k + PART] for x in (flat, m, v, slopes)) for k in range(0, len(flat), PART)]
    begin, end = span
    for k in range(windows):
        if k % each == 0:
            own = [texts[i] for i in rng.permutation(len(texts))]
            begins = np.zeros(n, bool)
            begins[np.cumsum([0, *map(len, own[:-1])])] = True
            words, first = (np.ascontiguousarray(np.resize(x, streams * length).reshape(streams, length).T) for x in (np.concatenate(own), begins))
            h = np.zeros((streams, HIDDEN), flat.dtype)
        at = slice(k % each * window, (k % each + 1) * window)
        slopes.fill(0)
        _, _, h = gradients(w, h, words[at].astype(np.int64), first[at], g)
        scale = 0.1 * min(1, 1 / max(float(np.sqrt(slopes @ slopes)), 1e-9))
        done = begin + (end - begin) * (k + 1) / (windows + 1)
        rate = RATE * min(1, 2 * (1 - done), 1 if begin == 0 else (k + 1) / WARM_UP)
        level = math.sqrt(1 - 0.99 ** (k + 1))
        for part in parts:  # each stays near the processor from its gradient to its step
            adam(*part, room[: len(part[0])], scale, rate * level / (1 - 0.9 ** (k + 1)), 1e-6 * level)
    return w


def train(texts: list[np.ndarray], counts: np.ndarray, rest: int, windows: int | None = None, seed: int = 5) -> Weights:
    """Weights fitted to the texts (arrays of numbers, each with its end) alone, in one place."""
    return learn(fresh(counts, rest, seed), texts, PASSES, windows=windows, seed=seed)


def log_likelihood(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each whole text, the state carried from its first word to its end."""
    return log_likelihoods(w, np.concatenate([np.zeros(0, np.int64), *texts]), np.array([len(x) for x in texts], np.int64))


def log_likelihoods(w: Weights, words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of texts that stand one after the other. Texts of like length are read side by side."""
    total = np.zeros(len(length))
    gates, turn = by_gate(w.gates), by_gate(w.turn)
    begin = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), ABREAST):
        own = order[k : k + ABREAST]
        start, left = begin[own], length[own]
        live_at = len(own) - np.searchsorted(left[::-1], np.arange(left[0]), side="right")
        h = np.zeros((len(own), HIDDEN), np.float32)
        said, held = [], 0
        states = ROOM("states", (LOOK + len(own), HIDDEN), h.dtype)
        for t, live in enumerate(live_at.tolist()):
            word = words.take(start[:live] + t).astype(np.int64)
            h = h[:live]
            states[held : held + live] = h
            said.append(word)
            held += live
            h = step(gates, turn, h, word, ROOM("a", (3, live, HIDDEN), h.dtype), ROOM("u", (live, HIDDEN), h.dtype))[0]
            if held >= LOOK or t + 1 == len(live_at):
                told, _ = output(w, states[:held], np.concatenate(said))
                owner = np.concatenate([np.arange(len(x)) for x in said])
                total[own] += np.bincount(owner, told, len(own))
                said, held = [], 0
    return total
