"""A small gated recurrent language model in numpy with a class-factored softmax.

Tokens are numbers by falling frequency.  The first ``words`` have weights of their own and are dealt into
classes of neighbouring numbers; every other word is known by its shape only, and each shape is a class
without members.  The log-probability of a token is that of its class plus, for a word, that of the word
in its class.  Output biases begin at the corpus frequencies and output weights at zero, so the untrained
model is the unigram one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 32


@dataclass
class Shape:
    """What the arrays of a model look like: words, shapes, and the first word of each class."""

    words: int
    shapes: int
    begins: np.ndarray  # of the classes of words, and their end
    hidden: int = HIDDEN

    @property
    def classes(self) -> int:
        return len(self.begins) - 1

    def class_of(self) -> np.ndarray:
        """Class of each token number, shapes last."""
        of_words = np.repeat(np.arange(self.classes), np.diff(self.begins))
        return np.r_[of_words, self.classes + np.arange(self.shapes)].astype(np.int32)


def frequency_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Begins of classes that share the square roots of the counts evenly; every class has a word."""
    n = len(counts)
    classes = max(1, min(classes, n))
    mass = np.cumsum(np.sqrt(counts))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1 if n else []
    return np.unique(np.r_[0, np.minimum(cuts, n), n]).astype(np.int64)


Arrays = dict[str, np.ndarray]


def initial(shape: Shape, counts: np.ndarray, seed: int = 7) -> Arrays:
    """Parameters before training; ``counts`` are those of the words, then of the shapes."""
    rng, h = np.random.default_rng(seed), shape.hidden
    weight = np.log(counts + 0.1)
    mass = np.r_[np.add.reduceat(counts[: shape.words] + 0.1, shape.begins[:-1]), counts[shape.words :] + 0.1]
    f = np.float32
    return {
        "in": rng.normal(0, 0.3, (shape.words + shape.shapes, 3 * h)).astype(f),
        "rec": (rng.normal(0, 1, (h, 3 * h)) * 0.5 / np.sqrt(h)).astype(f),
        "class_w": np.zeros((shape.classes + shape.shapes, h), f),
        "class_b": np.log(mass / mass.sum()).astype(f)[:, None],
        "word_w": np.zeros((shape.words, h), f),
        "word_b": weight[: shape.words].astype(f)[:, None],
    }


def _steps(p: Arrays, given: np.ndarray, keep: np.ndarray, state: np.ndarray, tape: list | None) -> np.ndarray:
    """States after each step; ``keep`` is 0 where a document begins."""
    h = p["rec"].shape[0]
    inputs = p["in"][given]
    out = np.empty((*given.shape, h), np.float32)
    for t in range(len(given)):
        before = state * keep[t][:, None]
        a = before @ p["rec"]
        gates = inputs[t, :, : 2 * h] + a[:, : 2 * h]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        r, z = gates[:, :h], gates[:, h:]
        fresh = np.tanh(inputs[t, :, 2 * h :] + r * a[:, 2 * h :])
        state = fresh + z * (before - fresh)
        out[t] = state
        if tape is not None:
            tape.append((before, a[:, 2 * h :], r, z, fresh))
    return out


#: Rows whose logits are held at a time.
BLOCK = 4096


def _softmax(states: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials, and the sums of these; logits are shifted only where that is needed."""
    logits = states @ weights.T
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        total = e @ np.ones(len(weights), np.float32)
    if not np.isfinite(total).all() or not total.all():
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
    return logits, e, total


def log_probs(
    p: Arrays, shape: Shape, class_of: np.ndarray, states: np.ndarray, targets: np.ndarray, grads: Arrays | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target after its state; with ``grads``, gradients of minus their sum
    are added there, and those of the states returned."""
    h = shape.hidden
    kinds = class_of[targets]
    full = np.concatenate([states, np.ones((len(states), 1), np.float32)], axis=1)
    found = np.empty(len(targets), np.float32)
    back = None if grads is None else np.empty_like(states)
    weights = np.concatenate([p["class_w"], p["class_b"]], axis=1)
    for i in range(0, len(targets), BLOCK):
        some, own = full[i : i + BLOCK], kinds[i : i + BLOCK]
        logits, e, total = _softmax(some, weights)
        rows = np.arange(len(own))
        found[i : i + BLOCK] = logits[rows, own] - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[rows, own] -= 1
            both = e.T @ some
            grads["class_w"] += both[:, :h]
            grads["class_b"] += both[:, h:]
            back[i : i + BLOCK] = e @ p["class_w"]
    order = np.argsort(kinds, kind="stable")
    cuts = np.searchsorted(kinds[order], np.arange(shape.classes + 1)).tolist()
    begins = shape.begins.tolist()
    weights = np.concatenate([p["word_w"], p["word_b"]], axis=1)
    order = order[: cuts[-1]]
    full, inside = full[order], targets[order] - shape.begins[kinds[order]]
    logs = np.zeros(len(order), np.float32)
    outer = None if grads is None else np.zeros((len(order), h), np.float32)
    rows = np.arange(min(BLOCK, len(order)))
    for k in range(shape.classes):
        a, b = begins[k], begins[k + 1]
        if b - a < 2:
            continue
        for i in range(cuts[k], cuts[k + 1], BLOCK):
            j = min(i + BLOCK, cuts[k + 1])
            some, own, at = full[i:j], inside[i:j], rows[: j - i]
            logits, e, total = _softmax(some, weights[a:b])
            logs[i:j] = logits[at, own] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[at, own] -= 1
                both = e.T @ some
                grads["word_w"][a:b] += both[:, :h]
                grads["word_b"][a:b] += both[:, h:]
                outer[i:j] = e @ weights[a:b, :h]
    found[order] += logs
    if grads is not None:
        back[order] += outer
    return found, back


@dataclass
class Lanes:
    """Documents side by side in lanes, longest lane first; a document stays in one lane."""

    given: list[np.ndarray]
    targets: list[np.ndarray]
    starts: list[np.ndarray]
    documents: list[list[int]]

    @classmethod
    def of(cls, documents: list[np.ndarray], end: int, width: int) -> Lanes:
        width = max(1, min(width, len(documents)))
        heap = [(0, i) for i in range(width)]
        own: list[list[int]] = [[] for _ in range(width)]
        load = [0] * width
        for d in sorted(range(len(documents)), key=lambda d: -len(documents[d])):
            _, i = heapq.heappop(heap)
            own[i].append(d)
            load[i] += len(documents[d])
            heapq.heappush(heap, (load[i], i))
        own.sort(key=lambda ds: -sum(len(documents[d]) for d in ds))
        given, targets, starts = [], [], []
        for ds in own:
            targets.append(np.concatenate([documents[d] for d in ds]))
            first = np.cumsum([0, *(len(documents[d]) for d in ds[:-1])])
            before = np.r_[end, targets[-1][:-1]]
            before[first] = end
            given.append(before)
            keep = np.ones(len(before), np.float32)
            keep[first] = 0
            starts.append(keep)
        return cls(given, targets, starts, own)

    def windows(self, steps: int):
        """(lanes in use, given, targets, keep, used) per window, each (steps, lanes)."""
        lengths = np.array([len(g) for g in self.given])
        for at in range(0, lengths[0], steps):
            active = int((lengths > at).sum())
            n = min(steps, lengths[0] - at)
            given, targets = np.zeros((n, active), np.int64), np.zeros((n, active), np.int64)
            keep, used = np.zeros((n, active), np.float32), np.zeros((n, active), bool)
            for i in range(active):
                m = min(n, lengths[i] - at)
                given[:m, i], targets[:m, i] = self.given[i][at : at + m], self.targets[i][at : at + m]
                keep[:m, i], used[:m, i] = self.starts[i][at : at + m], True
            yield active, given, targets, keep, used


def score(p: Arrays, shape: Shape, documents: list[np.ndarray], end: int, width: int = 256, steps: int = 128) -> np.ndarray:
    """Natural log-probability of whole documents (none of them empty); state is carried across windows."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    lanes, class_of = Lanes.of(documents, end, width), shape.class_of()
    state = np.zeros((len(lanes.given), shape.hidden), np.float32)
    found: list[list[np.ndarray]] = [[] for _ in lanes.given]
    for active, given, targets, keep, used in lanes.windows(steps):
        states = _steps(p, given, keep, state[:active], None)
        state = states[-1]
        flat = used.ravel()
        logs = np.zeros(flat.shape, np.float32)
        logs[flat], _ = log_probs(p, shape, class_of, states.reshape(-1, shape.hidden)[flat], targets.ravel()[flat])
        logs = logs.reshape(used.shape)
        for i in range(active):
            found[i].append(logs[used[:, i], i])
    for ds, parts in zip(lanes.documents, found, strict=True):
        logs = np.concatenate(parts).astype(np.float64)
        first = np.cumsum([0, *(len(documents[d]) for d in ds[:-1])])
        out[ds] = np.add.reduceat(logs, first)
    return out


def train(
    p: Arrays, shape: Shape, documents: list[np.ndarray], end: int, squares: Arrays, rate: float = 0.1, width: int = 128, steps: int = 24
) -> tuple[int, Arrays]:
    """Truncated backpropagation over the documents with Adagrad; changes ``p`` and ``squares``.

    Returns the tokens seen and how often each row of each array was used.
    """
    uses = {k: np.zeros(len(v)) for k, v in p.items()}
    seen = 0
    if not documents:
        return seen, uses
    lanes, class_of, h = Lanes.of(documents, end, width), shape.class_of(), shape.hidden
    state = np.zeros((len(lanes.given), h), np.float32)

    def step(name: str, gradient: np.ndarray) -> None:
        """Rows without a gradient stay as they are."""
        held = squares[name]
        held += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(held)
        p[name] -= gradient

    for active, given, targets, keep, used in lanes.windows(steps):
        tape: list = []
        states = _steps(p, given, keep, state[:active], tape)
        state = states[-1]
        flat = used.ravel()
        n = int(flat.sum())
        grads = {k: np.zeros_like(p[k]) for k in ("class_w", "class_b", "word_w", "word_b")}
        some = targets.ravel()[flat]
        _, back = log_probs(p, shape, class_of, states.reshape(-1, h)[flat], some, grads)
        outer = np.zeros((flat.size, h), np.float32)
        outer[flat] = back / n
        outer = outer.reshape(*used.shape, h)
        d_in, d_rec, after = np.empty((*used.shape, 3 * h), np.float32), np.zeros_like(p["rec"]), 0.0
        for t in range(len(used) - 1, -1, -1):
            before, a_new, r, z, fresh = tape[t]
            d = outer[t] + after
            dz = d * (before - fresh) * z * (1 - z)
            dn = d * (1 - z) * (1 - fresh * fresh)
            dr = dn * a_new * r * (1 - r)
            d_in[t, :, :h], d_in[t, :, h : 2 * h], d_in[t, :, 2 * h :] = dr, dz, dn
            da = np.concatenate([dr, dz, dn * r], axis=1)
            after = (d * z + da @ p["rec"].T) * keep[t][:, None]
            d_rec += before.T @ da
        ids = given.ravel()
        order = np.argsort(ids, kind="stable")
        rows, first = np.unique(ids[order], return_index=True)
        gradient = np.add.reduceat(d_in.reshape(-1, 3 * h)[order], first, axis=0)
        held = squares["in"][rows] + gradient * gradient
        squares["in"][rows] = held
        p["in"][rows] -= rate * gradient / np.sqrt(held)
        step("rec", d_rec)
        touched = np.unique(class_of[some[some < shape.words]])
        words = np.concatenate([np.arange(shape.begins[k], shape.begins[k + 1]) for k in touched] or [np.empty(0, np.int64)])
        for name, gradient in grads.items():
            gradient /= n
            step(name, gradient)
        for name in ("word_w", "word_b"):
            uses[name][words] += n
        uses["in"][rows] += np.diff(np.r_[first, len(ids)])
        for name in ("rec", "class_w", "class_b"):
            uses[name] += n
        seen += n
    return seen, uses


def no_squares(p: Arrays, floor: float = 1e-6) -> Arrays:
    return {k: np.full_like(v, floor) for k, v in p.items()}
