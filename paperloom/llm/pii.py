"""Personal data by a character-level bidirectional LSTM with a CRF on top, trained in numpy.

Kinds are EMAIL, PHONE, IP, CARD and SECRET in begin/inside tags. The network is trained on labelled
spans: windows of real text into which made-up items of each kind are set, together with decoys that
look alike (dates, prices, versions, times, handles, plain numbers, long words, paths).

The network reads every character of every text, in windows of 768 characters every 672; equal windows
of a batch are run once. Each window is decoded by Viterbi's algorithm. Where no tag but O can be on the
best path (no run of other tags, with the best transitions in its favour, gains over O) that path is known without the search. Then spans are reconciled over the document: a character takes
its tag from the window in which it lies nearest the middle; a span is widened to the whole run of
characters that its kind can hold and kept if the tags cover half of it; it is dropped if it can't be of
its kind (a card number must pass the Luhn check, an address's numbers must be under 256, a secret has 16
characters at least); and every other occurrence of a found text in the document gets the same kind.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import scan
from paperloom.session import written

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 768, 672
#: Length of the training windows.
TRAIN_WINDOW = 160
#: Documents that lend words to the training windows, and from how many places of its whole text each does, at most.
CARRIER_DOCS, CARRIER_PLACES, CARRIER_WORDS = 400, 8, 40
TRAINING_WINDOWS = 4000
EPOCHS = 6
_EMBED, _HIDDEN, _CHARS = 12, 20, 100
#: Window lengths are rounded up to a multiple of this, so that a window's padding depends on the window alone.
_STEP = 64
_BATCH, _SLICE_CHARS = 384, 1 << 24
_FORBIDDEN = -1e4
#: What a half in a natural exponent is as a step of a float's bits, the bits of 1, and how far the logistic function is followed.
_HALF_BITS, _ONE_BITS, _FAR = np.float32((1 << 23) / np.log(4)), np.int32(127 << 23), np.float32(160)
#: More than the sums over a window can err.
_ROUNDING = 0.05
_CODE = np.concatenate([np.full(32, 96), np.arange(32, 127) - 31, [97]]).astype(np.uint8)


def char_ids(text: str) -> np.ndarray:
    """One small number for each character: ASCII as it is, one for all others; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(code, 127)]


def _allowed() -> np.ndarray:
    out = np.zeros((len(TAGS), len(TAGS)))
    for a, before in enumerate(TAGS):
        for b, after in enumerate(TAGS):
            if after.startswith("I-") and before[2:] != after[2:]:
                out[a, b] = _FORBIDDEN
    return out


_RULES = _allowed()
_START = np.array([_FORBIDDEN if t.startswith("I-") else 0.0 for t in TAGS])


def _logistic_bits(at: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
    """The network's logistic function, in place, of numbers times _HALF_BITS; ``up`` and ``down`` are int32 room of their shape.

    It is ``e(x / 2) / (e(x / 2) + e(-x / 2))``, where ``e`` is exp with the mantissa taken in straight lines between powers of
    two: a number's bits as they are. It differs from the exact one by 0.0026 at most. numpy has tanh and exp in vector
    instructions on some processors only, and the rest of the work is less than they are on others.
    """
    np.copyto(up, at, casting="unsafe")
    np.subtract(_ONE_BITS, up, out=down)
    np.add(up, _ONE_BITS, out=up)
    up, down = up.view(np.float32), down.view(np.float32)
    np.add(up, down, out=down)
    np.divide(up, down, out=at)


def logistic(x: np.ndarray) -> np.ndarray:
    """The logistic function that training and search use."""
    at = np.clip(x, -_FAR, _FAR).astype(np.float32) * _HALF_BITS
    _logistic_bits(at, np.empty(at.shape, np.int32), np.empty(at.shape, np.int32))
    return at


def _both_ways(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, 2, B, H) over inputs (T, 2, B, E), direction 1 reversed in time, and what the gradient needs."""
    h_size = wh.shape[1]
    z = x @ wx + b[:, None]
    h = np.zeros((*z.shape[1:3], h_size), x.dtype)
    c, out, kept = np.zeros_like(h), np.empty((*z.shape[:3], h_size), x.dtype), []
    for t in range(len(z)):
        a = z[t] + h @ wh
        ifo, g = logistic(a[..., : 3 * h_size]), 2 * logistic(2 * a[..., 3 * h_size :]) - 1
        i, f, o = ifo[..., :h_size], ifo[..., h_size : 2 * h_size], ifo[..., 2 * h_size :]
        before = c
        c = f * c + i * g
        tc = 2 * logistic(2 * c) - 1
        kept.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return out, kept


def _both_ways_back(dout: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dz, dwh, back = np.empty((*dout.shape[:3], 4 * dout.shape[3]), x.dtype), np.zeros_like(wh), wh.swapaxes(1, 2)
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, before, tc, h = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
        dwh += h.swapaxes(1, 2) @ dz[t]
        dh, dc = dz[t] @ back, dc * f
    dwx = np.stack([x[:, k].reshape(-1, x.shape[3]).T @ dz[:, k].reshape(-1, dz.shape[3]) for k in range(2)])
    return dz @ wx.swapaxes(1, 2), dwx, dwh, dz.sum((0, 2))


def crf_loss(emit: np.ndarray, move: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood over the batch and its gradients by emissions and transitions."""
    t_max, n, k = emit.shape
    top = emit.max(2, keepdims=True)
    e, m = np.exp(emit - top), np.exp(move + _RULES)
    alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.empty((t_max, n, 1))
    for t in range(t_max):
        a = e[t] * ((alpha[t - 1] @ m) if t else np.exp(_START))
        norm[t] = a.sum(1, keepdims=True)
        alpha[t] = a / norm[t]
    for t in range(t_max - 2, -1, -1):
        beta[t] = ((e[t + 1] * beta[t + 1]) @ m.T) / norm[t + 1]
    z = (np.log(norm) + top).sum((0, 2))
    demit = alpha * beta
    dmove = alpha[:-1].reshape(-1, k).T @ (e[1:] * beta[1:] / norm[1:]).reshape(-1, k) * m
    row = np.arange(n)
    place = np.arange(t_max)[:, None], row[None], tags
    gold = _START[tags[0]] + emit[place].sum(0) + (move + _RULES)[tags[:-1], tags[1:]].sum(0)
    np.add.at(demit, place, -1)
    np.add.at(dmove, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    return float((z - gold).mean()), demit / n, dmove / n


def _joined(held: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Advantages put together to parts of about a batch, because the search goes step by step."""
    some: list[np.ndarray] = []
    for part in held:
        some.append(part)
        if sum(x.shape[2] for x in some) >= _BATCH:
            yield np.concatenate(some, 2)
            some = []
    if some:
        yield np.concatenate(some, 2)


@dataclass
class Tagger:
    """Weights: embedding; input, recurrent and bias of both LSTMs, gates in the order input, forget, output, candidate; output, bias, transitions."""

    theta: list[np.ndarray]

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(T, B, tags) of windows (B, T), and what the gradient needs."""
        embed, wx, wh, b, w, bias, _ = self.theta
        turned = np.stack([ids.T, ids.T[::-1]], 1)
        x = embed[turned]
        states, kept = _both_ways(x, wx, wh, b)
        both = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        return both @ w + bias, (turned, x, both, kept)

    def __post_init__(self) -> None:
        """What :meth:`advantage` runs on: state, input and bias weights in one matrix for each direction, for states
        kept halved, because tanh is ``2 (logistic(2 x) - 1 / 2)``, and in the unit that :func:`_logistic_bits` takes; below
        them the output weights, so that a step also gives what the state before it adds to the advantages."""
        embed, wx, wh, b, w, bias, _ = self.theta
        unit = np.repeat(np.array([1, 1, 1, 2], wx.dtype) * _HALF_BITS, _HIDDEN)
        gates = np.concatenate([wh * 2, wx, b[:, None]], 1).swapaxes(1, 2) * unit[:, None]
        told = np.zeros((2, len(TAGS) - 1, gates.shape[2]), wx.dtype)
        told[:, :, :_HIDDEN] = (w[:, 1:] - w[:, :1]).T.reshape(-1, 2, _HIDDEN).swapaxes(0, 1) * 2
        told[0, :, -1] = bias[1:] - bias[0]
        self._steps = np.ascontiguousarray(np.concatenate([gates, told], 1))
        self._wide = float(((np.abs(wh).sum(1) + np.abs(embed @ wx).max(1) + np.abs(b)) * unit).max()) > _FAR * _HALF_BITS
        self._chars = np.ascontiguousarray(embed.T)
        self._held = np.empty(0, wx.dtype)

    def advantage(self, ids: np.ndarray) -> np.ndarray:
        """(T, tags but O, B): how far the emission of each tag is above that of O; the next call writes over it."""
        n, t_max = ids.shape
        kind = self._steps.dtype
        size = 2 * t_max * n * (len(TAGS) - 1)
        if len(self._held) < size:  # kept for the next batch: fresh pages would cost as much as the sums
            self._held = np.empty(size, kind)
        ahead = self._held[:size].reshape(2, t_max, -1, n)
        turned = np.ascontiguousarray(ids.T).astype(np.intp)
        fed = np.zeros((2, _HIDDEN + _EMBED + 1, n), kind)
        fed[:, -1] = 1
        h, x = fed[:, :_HIDDEN], fed[:, _HIDDEN:-1]
        c, u = np.zeros((2, 2, _HIDDEN, n), kind)
        a = np.empty((2, self._steps.shape[1], n), kind)
        gates, told = a[:, : 4 * _HIDDEN], a[:, 4 * _HIDDEN :]
        bits, cell_bits, most = np.empty((2, *gates.shape), np.int32), np.empty((2, *c.shape), np.int32), _FAR * _HALF_BITS
        half, scale = kind.type(0.5), 4 * _HALF_BITS
        i, f, o, g = (gates[:, k * _HIDDEN : (k + 1) * _HIDDEN] for k in range(4))
        for t in range(t_max + 1):
            if t < t_max:
                self._chars.take(turned[t], axis=1, out=x[0], mode="clip")
                self._chars.take(turned[t_max - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(self._steps, fed, out=a)
            if t:
                ahead[0, t - 1], ahead[1, t_max - t] = told
            if t == t_max:
                break
            if self._wide:
                np.clip(gates, -most, most, out=gates)
            _logistic_bits(gates, *bits)
            np.subtract(g, half, out=g)
            np.multiply(i, g, out=g)
            np.multiply(f, c, out=c)
            np.add(c, g, out=c)
            np.multiply(c, scale, out=u)
            np.clip(u, -most, most, out=u)
            _logistic_bits(u, *cell_bits)
            np.subtract(u, half, out=u)
            np.multiply(o, u, out=h)
        return np.add(ahead[0], ahead[1], out=ahead[0])

    def candidates(self, ahead: np.ndarray) -> np.ndarray:
        """The windows, of their advantages, on whose best path another tag than O may be.

        A path that leaves O is made of runs of one kind. What a run can gain over O is at most the
        advantage of the tag that begins it with the best transition into it, those of its inside
        tags with the best transition within, and the best transition out of it; where no run
        can gain, which the best run that ends at each place tells, the path O throughout is the best.
        """
        move = self.theta[-1] - self.theta[-1][0, 0]
        best_of = lambda v: v.max(0)[:, None].astype(ahead.dtype)
        into, within = best_of(move[:, 1::2]), best_of(np.where(_RULES == 0, move, _FORBIDDEN)[:, 2::2])
        run, start = np.full((2, len(KINDS), ahead.shape[2]), _FORBIDDEN, ahead.dtype)
        most = run.copy()
        for now in ahead:
            np.add(run, within, out=run)
            np.add(run, now[1::2], out=run)
            np.add(now[0::2], into, out=start)
            np.maximum(run, start, out=run)
            np.maximum(most, run, out=most)
        return np.flatnonzero(most.max(0) > -max(0.0, float(move[1:, 0].max())) - _ROUNDING)

    def best_paths(self, ahead: np.ndarray) -> np.ndarray:
        """(B, T): the best tag sequence of each window, by Viterbi's algorithm."""
        t_max, _, n = ahead.shape
        emit = np.concatenate([np.zeros((t_max, 1, n), ahead.dtype), ahead], 1).transpose(0, 2, 1)
        move = (self.theta[-1] + _RULES).astype(emit.dtype)
        best, back, row = emit[0] + _START.astype(emit.dtype), [], np.arange(n)
        for t in range(1, t_max):
            way = best[:, :, None] + move
            back.append(way.argmax(1).astype(np.uint8))
            best = emit[t] + way.max(1)
        out = np.empty((n, t_max), np.uint8)
        out[:, -1] = best.argmax(1)
        for t in range(t_max - 2, -1, -1):
            out[:, t] = back[t][row, out[:, t + 1]]
        return out

    def tags(self, ids: np.ndarray, prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(rows, their best tag sequences) of windows (B, T); rows that aren't named are O throughout.

        Without ``prune`` all rows are searched and named.
        """
        rows, held = [np.zeros(0, np.int64)], []
        for i in range(0, len(ids), _BATCH):
            ahead = self.advantage(ids[i : i + _BATCH])
            own = self.candidates(ahead) if prune else np.arange(ahead.shape[2])
            rows.append(own + i)
            held.append(ahead[:, :, own])
        found = [self.best_paths(part) for part in _joined(held)]
        return np.concatenate(rows), np.concatenate(found) if found else np.zeros((0, ids.shape[1]), np.uint8)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the weights as a table of one row."""
        held = io.BytesIO()
        np.savez(held, *self.theta)
        spark.createDataFrame([(bytearray(held.getvalue()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tagger:
        """A tagger from what :meth:`save` wrote."""
        held = np.load(io.BytesIO(bytes(spark.read.parquet(path).first().weights)))
        return cls([held[f"arr_{k}"] for k in range(len(held.files))])


def train(windows: np.ndarray, tags: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Tagger:
    """A tagger from windows of character ids (N, T) and their tags."""
    rng = np.random.default_rng(seed)
    k, kind = len(TAGS), np.float32

    def weights(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(kind)

    bias = np.zeros((2, 4 * _HIDDEN), kind)
    bias[:, _HIDDEN : 2 * _HIDDEN] = 1  # forget gates start open
    theta = [rng.normal(0, 0.5, (_CHARS, _EMBED)).astype(kind), weights(2, _EMBED, 4 * _HIDDEN), weights(2, _HIDDEN, 4 * _HIDDEN), bias, weights(2 * _HIDDEN, k), np.zeros(k, kind), np.zeros((k, k), kind)]
    model, first, second = Tagger(theta), [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step, size = 0, 48
    total = epochs * max(1, len(windows) // size)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), size):
            step += 1
            ids, gold = windows[order[i : i + size]], tags[order[i : i + size]].T
            emit, (turned, x, both, kept) = model.emissions(ids)
            _, demit, dmove = crf_loss(emit.astype(np.float64), theta[6].astype(np.float64), gold)
            demit = demit.astype(kind)
            dboth = demit @ theta[4].T
            dx, dwx, dwh, db = _both_ways_back(np.stack([dboth[..., :_HIDDEN], dboth[::-1, :, _HIDDEN:]], 1), x, theta[1], theta[2], kept)
            dembed = np.stack([np.bincount(turned.ravel(), weights=dx[..., e].ravel(), minlength=_CHARS) for e in range(_EMBED)], 1).astype(kind)
            grads = [dembed, dwx, dwh, db, both.reshape(-1, 2 * _HIDDEN).T @ demit.reshape(-1, k), demit.sum((0, 1)), dmove.astype(kind)]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = 0.015 * min(1, 5 / (norm + 1e-9)) * (1 - 0.9 * step / (total + 1))
            for j, g in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.99 * second[j] + 0.01 * g * g
                theta[j] -= (rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)).astype(kind)
    return Tagger(theta)


def luhn(digits: str) -> bool:
    """The check-digit rule of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_RUN = {"EMAIL": r"[\w.+\-@]", "PHONE": r"[\d ()+\-]", "IP": r"[\d.]", "CARD": r"[\d \-]", "SECRET": r"[A-Za-z0-9_+/\-]"}
_INSIDE = {k: re.compile(v) for k, v in (*_RUN.items(), ("PHONE", r"\d"), ("CARD", r"\d"))}
_EMAIL = re.compile(r"[\w+\-]+(?:\.[\w+\-]+)*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")
_CARD = re.compile(r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)")
_DIGITS = re.compile(r"\d+")
_PHONE = re.compile(r"\+?[\d(][\d ()\-]*\d")
_SECRET = re.compile(r"[A-Za-z0-9_+/\-]{16,}")


def _settled(text: str, kind: str, start: int, end: int) -> list[tuple[int, int]]:
    """What of the span, widened to whole runs of its kind's characters, can be of that kind."""
    run = _INSIDE[kind]
    while start > 0 and run.match(text[start - 1]):
        start -= 1
    while end < len(text) and run.match(text[end]):
        end += 1
    if kind == "PHONE":
        start -= text[max(0, start - 1) : start] == "("
        start -= text[max(0, start - 1) : start] == "+"
    own = text[start:end]
    number = lambda m: re.sub(r"\D", "", m.group())
    if kind == "EMAIL":
        hits = list(_EMAIL.finditer(own))
    elif kind == "IP":
        hits = [m for m in _IP.finditer(own) if all(int(p) < 256 for p in m.group().split("."))]
    elif kind == "CARD":
        hits = [m for m in _DIGITS.finditer(own) if 13 <= len(m.group()) <= 19 and luhn(m.group())]
        hits = hits or [m for m in _CARD.finditer(own) if luhn(number(m))]
    elif kind == "PHONE":
        hits = [m for m in _PHONE.finditer(own) if 7 <= len(number(m)) <= 15]
    else:
        hits = list(_SECRET.finditer(own))
    return [(start + m.start(), start + m.end()) for m in hits]


def reconcile(text: str, tag: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) spans of a document from one tag for each character, in order and disjoint."""
    found: list[tuple[int, int, str]] = []
    i = 0
    while i < len(tag):
        if tag[i] == 0:
            i += 1
            continue
        kind = TAGS[tag[i]][2:]
        j = i + 1
        while j < len(tag) and TAGS[tag[j]] == f"I-{kind}":
            j += 1
        found += [(s, e, kind) for s, e in _settled(text, kind, i, j) if 2 * (min(e, j) - max(s, i)) >= e - s]
        i = j
    for surface, kind in {(text[s:e], k) for s, e, k in found}:
        at = text.find(surface)
        while at >= 0:
            edge = lambda p: 0 <= p < len(text) and bool(_INSIDE[kind].match(text[p]))  # noqa: B023, E731
            if not edge(at - 1) and not edge(at + len(surface)):
                found.append((at, at + len(surface), kind))
            at = text.find(surface, at + len(surface))
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(set(found), key=lambda s: (s[0], -s[1], s[2])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    return out


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the windows that cover texts of these lengths."""
    count = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, start, np.minimum(WINDOW, lengths[text] - start)


def spans(model: Tagger, texts: list[str], prune: bool = True) -> list[list[tuple[int, int, str]]]:
    """The spans of whole texts; ``prune`` is that of :meth:`Tagger.tags` and changes no result."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.concatenate([char_ids("".join(texts)), np.zeros(WINDOW, np.uint8)])
    base = np.cumsum(lengths) - lengths
    text, start, length = windows_of(lengths)
    tag = np.zeros(len(codes), np.uint8)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    margin = (WINDOW - STRIDE) // 2
    padded = -(-length // _STEP) * _STEP
    for size in np.unique(padded):
        own = np.flatnonzero(padded == size)
        at = np.arange(size)
        ids = codes[(base[text[own]] + start[own])[:, None] + at] * (at < length[own][:, None])
        ids, which = np.unique(np.ascontiguousarray(ids).view(f"V{size}").ravel(), return_inverse=True)
        ids = ids.view(np.uint8).reshape(-1, size)
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(ids) + 1))
        for row, found in zip(*model.tags(ids, prune), strict=True):
            if not found.any():
                continue
            for k in own[order[first[row] : first[row + 1]]]:
                a, b = margin if start[k] else 0, length[k] if last[k] else STRIDE + margin
                to = base[text[k]] + start[k]
                tag[to + a : to + b] = found[a:b]
    hit = np.add.reduceat(np.append(tag > 0, False), np.append(base, len(tag)))[:-1] * (lengths > 0) if len(texts) else []
    return [reconcile(t, tag[b : b + n]) if h else [] for t, b, n, h in zip(texts, base, lengths, hit, strict=True)]


def _item(rng: np.random.Generator, kind: str) -> tuple[str, str, str]:
    """(what stands before, the item, what stands after)."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(a, b))))
    pick = lambda *x: str(rng.choice(x))
    if kind == "EMAIL":
        name = word(2, 14) + pick("", "", f".{digits(2)}", f"_{word(2, 6)}", digits(2), f".{word(2, 8)}", f"+{word(2, 5)}")
        return "", f"{name}@{word(3, 9)}{pick('', digits(1))}.{pick('example.com', 'com', 'org', 'net', 'co.uk', 'example.org', 'de')}", ""
    if kind == "PHONE":
        a, b, c = digits(3), digits(3) if rng.random() < 0.6 else "555", digits(4)
        return "", pick(f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+49 {a} {digits(7)}", f"{a}-{b}-{c}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"), ""
    if kind == "IP":
        return "", ".".join(str(rng.integers(0, 256)) for _ in range(4)), ""
    if kind == "CARD":
        n = pick("4", "5", "9", "3", "") + digits(15)
        n = n[:16] if len(n) >= 16 else n + digits(16 - len(n))
        return "", n if rng.random() < 0.8 else pick(" ", "-").join(n[i : i + 4] for i in range(0, 16, 4)), ""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    way = rng.random()
    body = "".join(rng.choice(list("0123456789abcdef"), int(rng.choice([32, 40, 40, 40, 64])))) if way < 0.6 else "".join(rng.choice(list(letters + "0123456789" * (way < 0.8)), int(rng.integers(24, 44))))
    quote = pick('"', '"', "'", "")
    return pick("token = ", "token = ", "key: ", "secret=", "password = ", "api_key = ") + quote, body, quote


def _decoy(rng: np.random.Generator, words: list[str]) -> str:
    if rng.random() < 0.3:  # what has the length of a secret and is none
        some = [re.sub(r"\W", "", str(w)) for w in (words[i] for i in rng.integers(0, len(words), int(rng.integers(2, 6))))]
        return str(rng.choice(["", "", "_", "-", "/", "."])).join(some)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return str(rng.choice([digits(4), digits(2), f"{digits(1)}.{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"${digits(3)}.{digits(2)}", f"#{digits(5)}", "@name", "@", f"{digits(3)}%", "x" + digits(3), digits(6), f"{digits(1)},{digits(3)}", f"1{digits(3)}"]))


def labelled_windows(carriers: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows with their tags: pieces of the carriers with items and decoys set between words."""
    rng = np.random.default_rng(seed)
    words = [w for t in carriers for w in t.split() if not re.search(r"[0-9@]", w)] or ["a", "text", "of", "words"]
    ids, tags = np.zeros((n, TRAIN_WINDOW), np.uint8), np.zeros((n, TRAIN_WINDOW), np.int64)
    for k in range(n):
        start = int(rng.integers(0, len(words)))
        mode = rng.random()
        parts: list[tuple[str, str]] = []
        for w in [words[(start + j) % len(words)] for j in range(40)]:
            chance = rng.random()
            if chance < 0.16:
                kind = str(rng.choice(KINDS))
                before, item, after = _item(rng, kind)
                if before:
                    parts.append((before, ""))
                parts.append((item, kind))
                if after:
                    parts.append((after, ""))
                parts.append((str(rng.choice([" ", " ", " ", ". ", ", ", "\n", "!! ", "%%% ", "### ", "*** ", " | "])), ""))
            elif chance < 0.24:
                parts.append((_decoy(rng, words) + " ", ""))
            parts.append((w + (str(rng.choice(["!!", "%%%", "***", "$$$"])) if mode < 0.1 else "") + (" | " if mode > 0.95 else " "), ""))
        text = "".join(p for p, _ in parts)
        tag = np.zeros(len(text), np.int64)
        at = 0
        for p, kind in parts:
            if kind:
                tag[at : at + len(p)] = 2 + 2 * KINDS.index(kind)
                tag[at] -= 1
            at += len(p)
        if mode < 0.08:
            up = text.upper()
            text = up if len(up) == len(text) else text
        cut = int(rng.integers(0, max(1, min(120, len(text) - TRAIN_WINDOW)))) if rng.random() < 0.9 else 0
        own, own_tag = char_ids(text)[cut : cut + TRAIN_WINDOW], tag[cut : cut + TRAIN_WINDOW].copy()
        inside = own_tag[0] > 0 and own_tag[0] % 2 == 0
        if inside:  # a window that begins within an item begins one
            own_tag[0] -= 1
        if rng.random() < 0.25:  # a text that ends in the window
            end = int(rng.integers(1, TRAIN_WINDOW))
            own, own_tag = own[:end], own_tag[:end]
        ids[k, : len(own)], tags[k, : len(own)] = own, own_tag
    return ids, tags


def _lent(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        out = []
        for h, t in zip(batch["h"], batch["t"], strict=True):
            words, rng = t.split(), np.random.default_rng(h & 0x7FFFFFFF)
            starts = rng.integers(0, max(1, len(words)), CARRIER_PLACES) if len(words) > CARRIER_PLACES * CARRIER_WORDS else range(0, len(words), CARRIER_WORDS)
            out.append((h, " ".join(w for s in starts for w in words[s : s + CARRIER_WORDS])))
        yield pd.DataFrame(out, columns=["h", "t"])


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carriers: int = CARRIER_DOCS, windows: int = TRAINING_WINDOWS, seed: int = 0) -> Tagger:
    """A tagger whose training windows borrow the words of at most ``carriers`` documents, those of least id hash.

    A document lends at most CARRIER_PLACES runs of CARRIER_WORDS words, from places all over its text.
    No documents, or texts without words, leave the network with items between a few stock words.
    """
    chosen = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h")).distinct().orderBy("h").limit(carriers)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "h")  # carriers rows at most
    lent = texts.mapInPandas(_lent, "h bigint, t string").groupBy("h").agg(F.min("t").alias("t"))
    rows = sorted(written(lent, "pii-carriers").collect())  # one bounded row for each carrier
    return train(*labelled_windows([r.t for r in rows], windows, seed), seed)


def _find(model: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            _, offsets = scan.string_buffers(texts)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE_CHARS, side="right")) - 1)
                found = spans(model, [t or "" for t in texts.slice(i, j - i).to_pylist()])
                flat = [(r, *s) for r, ss in enumerate(found, i) for s in ss]
                at = pa.array([f[0] for f in flat], pa.int64())
                cols = [batch.column(0).take(at), *(pa.array([f[c] for f in flat], t) for c, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string())))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "end", "kind"])
                i = j

    return run


def find_private(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind): every span of personal data, in characters from 0, end exclusive.

    Whole texts are searched, however long. Null and empty texts have no spans; repeated rows give
    repeated spans; a null doc_id is carried along; of spans that overlap the first counts, then the
    longest. Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_find(model), f"doc_id {kind}, start int, end int, kind string")
