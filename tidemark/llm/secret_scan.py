"""Secrets in whole texts: fixed rules, and a character convolutional network over every other candidate.

Candidates are the rules' findings and all other runs of :data:`RUN` characters. The network reads each candidate whole, with
the characters before and behind it: an embedding of character classes, one convolution, the largest response inside
the candidate, before it and behind it, and a logistic output. It is trained in numpy on all labelled candidates of the documents, in groups side by side,
those that a rule names being secrets. Half of the copies of a secret have its surroundings or its name hidden or its
characters drawn anew, so that values are told by their own characters too; some copies of the others are put in capitals or made
numbers, which are no secrets by themselves. Scores are calibrated on a held-out part
(Platt). The threshold is even odds, or as far below as keeps the wanted share of that part's secrets (recall), but never so low
that more than a small share of its other candidates pass. The rules' findings always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from .common import blocks, over_batches, saved, text_list

# fixed values: the rules in their order, and the least length of a finding (of group 2 for ``assign``)
RULES = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
]
#: One of these is in the lower case of a text with a finding of ``assign``.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
NAMED = "model"
KINDS = [k for k, *_ in RULES] + [NAMED]

#: Characters before and behind a candidate that the network reads.
SIDE = 24
CLASSES, WIDTH, DEPTH, FILTERS = 100, 5, 8, 16
#: Rounds of learning; other candidates of a group and round, about, and of a batch beside how many secrets; candidates that are learned from at least, counting those learned from
#: again; secrets of a group at least.
ROUNDS, GROUP, OTHERS, SECRETS, LEAST_SEEN, LEAST_SECRETS = 12, 4_000, 64, 64, 40_000, 50
#: Characters that the network reads at once; a longer candidate is read in strips.
STRIP = 100_000


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, place of its rule)`` of all findings of the rules, by start, then rule."""
    out = []
    low = text.lower()
    may = (any(w in low for w in NAMES), "AKIA" in text, True)  # most texts hold no finding of the first two
    for k, (_, pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text) if may[k] else ():
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def value_span(text: str, start: int, end: int, rule: int) -> tuple[int, int]:
    """The value inside a finding."""
    _, pattern, group, _ = RULES[rule]
    m = pattern.match(text, start, end)
    return m.span(group)


def candidate_spans(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that touch no finding of a rule."""
    starts, ends = [], []  # the findings' cover, apart from each other
    for a, b, _ in found:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        k = bisect_right(ends, a)
        if k == len(starts) or starts[k] >= b:
            out.append((a, b))
    return out


def codes(text: str) -> np.ndarray:
    """A class for each character: ASCII on its own, letters, digits, white space and others beyond it together; 0 is the edge."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(raw), 97, np.uint8)
    plain = (raw >= 32) & (raw < 127)
    out[plain] = raw[plain] - 31
    out[(raw < 32) | (raw == 0x85) | (raw == 0xA0)] = 96
    out[raw > 0x2FF] = 98
    return out


@dataclass
class Windows:
    """Candidates with their surroundings, one after another: classes, and for each its begin, candidate's begin and end, and end."""

    flat: np.ndarray
    cut: np.ndarray  # (n, 4)

    @classmethod
    def of(cls, text_codes: list[np.ndarray], spans: list[list[tuple[int, int]]]) -> Windows:
        parts, cut, at = [], [], 0
        for c, some in zip(text_codes, spans, strict=True):
            for a, b in some:
                lo, hi = max(0, a - SIDE), min(len(c), b + SIDE)
                parts.append(c[lo:hi])
                cut.append((at, at + a - lo, at + b - lo, at + hi - lo))
                at += hi - lo
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return cls(flat, np.array(cut, np.int64).reshape(-1, 4))


@dataclass
class Network:
    embed: np.ndarray  # (CLASSES, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (3 * FILTERS,)
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # nothing passes

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls(
            rng.normal(0, 0.5, (CLASSES, DEPTH)), rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.1, 3 * FILTERS), 0.0,
        )

    def _tables(self) -> np.ndarray:
        """The filters' answer to each class at each offset: the convolution adds up rows of these small tables."""
        return np.einsum("cd,wdf->wcf", self.embed, self.filters.reshape(WIDTH, DEPTH, FILTERS)).astype(np.float32)

    def _answer(self, x: np.ndarray, tables: np.ndarray) -> np.ndarray:
        response = tables[0][x[:, 0]] + self.bias.astype(np.float32)
        for k in range(1, WIDTH):
            response += tables[k][x[:, k]]
        return np.maximum(response, 0, out=response)

    def _forward(self, w: Windows) -> tuple:
        """The classes around each place, the filters' responses there, each window's cuts among the places, and the largest
        responses of its three parts."""
        n, size, gap = len(w.cut), w.cut[:, 3] - w.cut[:, 0], WIDTH // 2
        before = np.cumsum(size) - size
        own = np.arange(int(size.sum()))
        # an edge before, between and behind windows, so that none sees its neighbour
        place = own + np.repeat(gap * np.arange(1, n + 1), size)
        flat = np.zeros(len(own) + gap * (n + 1), np.uint8)
        flat[place] = w.flat[own + np.repeat(w.cut[:, 0] - before, size)]
        x = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[place - gap]
        response = self._answer(x, self._tables())
        local = w.cut - w.cut[:, :1] + before[:, None]
        pooled = np.zeros((n, 3, FILTERS), np.float32)
        for part in range(3):
            lo, hi = local[:, part], local[:, part + 1]
            some = np.flatnonzero(hi > lo)
            if len(some):
                pooled[some, part] = _segment_max(response, lo[some], hi[some])
        return x, response, local, pooled

    def _long(self, w: Windows) -> np.ndarray:
        """The same largest responses for one long window, in strips."""
        gap, tables, pooled = WIDTH // 2, self._tables(), np.zeros((1, 3, FILTERS), np.float32)
        flat = np.concatenate((np.zeros(gap, np.uint8), w.flat, np.zeros(gap, np.uint8)))
        for part in range(3):
            for at in range(int(w.cut[0, part]), int(w.cut[0, part + 1]), STRIP):
                stop = min(at + STRIP, int(w.cut[0, part + 1]))
                x = np.lib.stride_tricks.sliding_window_view(flat[at : stop + 2 * gap], WIDTH)
                pooled[0, part] = np.maximum(pooled[0, part], self._answer(x, tables).max(0))
        return pooled

    def logits(self, w: Windows) -> np.ndarray:
        out = np.zeros(len(w.cut))
        size = np.cumsum(w.cut[:, 3] - w.cut[:, 0])
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STRIP, side="right")))
            some = _take(w, np.arange(lo, hi))
            pooled = self._long(some) if len(some.flat) > STRIP else self._forward(some)[3]
            out[lo:hi] = pooled.reshape(hi - lo, -1) @ self.out + self.out_bias
            lo = hi
        return out

    def probability(self, w: Windows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(w) + self.shift, -50, 50)))

    def step(self, w: Windows, label: np.ndarray, moments: dict, t: int, rate: float = 0.01, weight: np.ndarray | None = None) -> None:
        """One step of Adam on the logistic loss of a batch: its mean, or the sum by ``weight``."""
        n = len(label)
        x, response, local, pooled = self._forward(w)
        features, largest = pooled.reshape(n, -1), pooled.reshape(-1, FILTERS)
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.out_bias, -50, 50)))
        d = (p - label) * (1 / n if weight is None else weight)
        grad = {"out": features.T @ d + 1e-4 * self.out, "out_bias": d.sum()}
        back = (d[:, None] * self.out[None, :]).reshape(-1, FILTERS)
        # only the places of the largest responses pass it on; equal ones share it
        part = np.repeat(np.arange(3 * n), np.diff(local, axis=1).reshape(-1))
        at, f = np.nonzero((response == largest[part]) & (response > 0))
        cell = part[at] * FILTERS + f
        g = back.reshape(-1)[cell] / np.bincount(cell, minlength=back.size)[cell]
        grad["bias"] = np.bincount(f, g, FILTERS)
        tables = np.stack([np.bincount(x[at, k].astype(np.int64) * FILTERS + f, g, CLASSES * FILTERS).reshape(CLASSES, FILTERS) for k in range(WIDTH)])
        grad["filters"] = np.einsum("cd,wcf->wdf", self.embed, tables).reshape(-1, FILTERS)
        grad["embed"] = np.einsum("wcf,wdf->cd", tables, self.filters.reshape(WIDTH, DEPTH, FILTERS))
        for name, g in grad.items():
            m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            moments[name] = [m, v]
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))


def _segment_max(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest rows of ``x[lo:hi]`` for each segment (none is empty)."""
    edge = np.stack((lo, hi), 1).reshape(-1)
    inside = np.concatenate((x, np.full((1, x.shape[1]), -np.inf)))
    return np.maximum.reduceat(inside, edge, axis=0)[::2]


#: Parameters that are learned, in their order.
LEARNED = ("embed", "filters", "bias", "out", "out_bias")


def _packed(net: Network, moments: dict) -> np.ndarray:
    return np.concatenate([np.ravel(x) for k in LEARNED for x in (getattr(net, k), *moments.get(k, [np.zeros_like(getattr(net, k))] * 2))]).astype(float)


def _unpacked(values: np.ndarray) -> tuple[Network, dict]:
    net, moments, at = Network.fresh(np.random.default_rng(0)), {}, 0
    for k in LEARNED:
        shape = np.shape(getattr(net, k))
        size = int(np.prod(shape))
        own = [values[at + i * size : at + (i + 1) * size].reshape(shape) for i in range(3)]
        at += 3 * size
        setattr(net, k, own[0])
        moments[k] = own[1:]
    return net, moments


def _windows(rows: pd.DataFrame) -> tuple[Windows, np.ndarray]:
    """The candidates of a group in an order that does not depend on where they came from, and their labels."""
    rows = rows.sort_values(["secret", "dealt", "a", "b", "seen"])
    size = rows["seen"].map(len).to_numpy(np.int64)
    at = np.cumsum(size) - size
    cut = np.stack((at, at + rows["a"].to_numpy(), at + rows["b"].to_numpy(), at + size), 1)
    return Windows(np.frombuffer(b"".join(rows["seen"]), np.uint8), cut), rows["secret"].to_numpy(bool)


def _learn(values: np.ndarray, windows: Windows, label: np.ndarray, t: int, rng: np.random.Generator, rate: float) -> np.ndarray:
    """Parameters after a pass over a group's candidates: each other candidate once, beside secrets drawn anew for each batch."""
    net, moments = _unpacked(values)
    secrets, others = np.flatnonzero(label), rng.permutation(np.flatnonzero(~label))
    size = (windows.cut[:, 3] - windows.cut[:, 0])[others]
    first = 0
    while first < len(others) and len(secrets):
        last = first + max(1, int(np.searchsorted(np.cumsum(size[first : first + OTHERS]), STRIP, side="right")))
        some = np.concatenate((rng.choice(secrets, SECRETS), others[first:last]))
        yes = np.arange(len(some)) < SECRETS
        t += 1
        net.step(_varied(_take(windows, some), yes, rng), yes.astype(float), moments, t, rate, np.where(yes, 0.5 / SECRETS, 0.5 / (last - first)))
        first = last
    return _packed(net, moments)


def _learner(values: np.ndarray, t: int, seeds: tuple[int, int], rate: float):
    def learn(key, rows):
        got = _learn(values, *_windows(rows), t, np.random.default_rng((*seeds, int(key[0]))), rate)
        return pd.DataFrame({"i": np.arange(len(got)), "v": got})

    return learn


def train(candidates: DataFrame, recall: float = 0.99, false_share: float = 0.001, seed: int = 7) -> Network | None:
    """A network fit on all of the labelled ``candidates`` (:func:`labelled`); None where one of the two labels is missing.

    Four fifths of the candidates are learned from, the rest gives calibration and threshold. Candidates are dealt into groups by hash; in each
    of :data:`ROUNDS` rounds all groups learn side by side from the same parameters and the means of theirs begin the next round. Each candidate is learned from in
    every round of a small table and in one round of a large one; secrets, which are few, in every round, and in several groups where a group would have too few.
    """
    dealt = saved(candidates.withColumn("dealt", F.xxhash64("seen", "a", "b")))
    held = F.pmod("dealt", F.lit(5)) == 0
    n = {(r.held, r.secret): r.n for r in dealt.groupBy(held.alias("held"), "secret").agg(F.count("*").alias("n")).collect()}
    if not all(sum(n.get((h, s), 0) for h in (True, False)) for s in (True, False)):
        return None
    apart = all(n.get((h, s), 0) for h in (True, False) for s in (True, False))
    fit, test = (dealt.where(~held), dealt.where(held)) if apart else (dealt, dealt)
    secrets, others = (sum(n.get((h, s), 0) for h in ((False,) if apart else (True, False))) for s in (True, False))
    passes = next((p for p in (1, 2, 3, 4, 6) if p * others >= LEAST_SEEN), ROUNDS)
    turns = ROUNDS // passes
    groups = max(1, others // (turns * GROUP))
    copies = min(groups, -(-groups * LEAST_SECRETS // secrets))
    place, turn = F.pmod(F.shiftright("dealt", 8), F.lit(groups)), F.pmod(F.shiftright("dealt", 40), F.lit(turns))
    mine = fit.where("secret").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("group", F.pmod(place + F.col("copy"), F.lit(groups))).drop("copy")
    rest = fit.where("not secret").withColumn("group", place)
    values, t, steps = _packed(Network.fresh(np.random.default_rng(seed)), {}), 0, -(-others // (turns * groups * OTHERS))
    for r in range(ROUNDS):
        rate = 0.01 * (1 - 0.8 * r / ROUNDS)

        each = mine.unionByName(rest.where(turn == r % turns)).groupBy("group").applyInPandas(_learner(values, t, (seed, r), rate), "i int, v double")
        # whole numbers, so that the mean does not depend on the order of the groups
        mean = each.groupBy("i").agg(F.sum((F.col("v") * 2.0**60).cast("decimal(38,0)")).cast("double").alias("v"), F.count("*").alias("n"))
        values = np.array([x.v / x.n / 2.0**60 for x in sorted(mean.collect(), key=lambda x: x.i)])  # fixed in number: the parameters
        t += steps
    net = _unpacked(values)[0]

    def score(key, rows):
        windows, label = _windows(rows)
        return pd.DataFrame({"secret": label, "shown": net.logits(_varied(windows, label, np.random.default_rng((seed, ROUNDS, int(key[0]))))), "plain": net.logits(windows)})

    parts = max(1, sum(n.values()) // (5 * GROUP))
    scored = saved(test.withColumn("group", F.pmod(F.shiftright("dealt", 8), F.lit(parts))).groupBy("group").applyInPandas(score, "secret boolean, shown double, plain double"))
    net.scale, net.shift = _platt(scored)
    p = lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), net.scale * F.col(z) + net.shift))))
    told = scored.select(F.explode(F.array(
        F.struct(F.when(F.col("secret"), "secret").otherwise("shown").alias("kind"), p("shown").alias("p")), F.struct(F.when(~F.col("secret"), "plain").alias("kind"), p("plain").alias("p")),
    )).alias("x")).select("x.*").where("kind is not null")
    at = {r.kind: r.quantiles for r in quantiles(told, ["kind"], "p", [1 - recall, 1 - false_share]).collect()}
    net.threshold = float(max(min(at["secret"][0], 0.5), np.nextafter(max(at["shown"][1], at["plain"][1]), 2)))
    return net


def _take(w: Windows, rows: np.ndarray) -> Windows:
    size = w.cut[rows, 3] - w.cut[rows, 0]
    at = np.cumsum(size) - size
    flat = w.flat[np.repeat(w.cut[rows, 0] - at, size) + np.arange(int(size.sum()))]
    return Windows(flat, w.cut[rows] - w.cut[rows, :1] + at[:, None])


#: Alphabets that the values of some copies are drawn from anew: hex, upper case and digits, all letters and digits, base64.
_ALPHABETS = [np.frombuffer(a.encode(), np.uint8) - 31 for a in (
    "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
)]


def _varied(w: Windows, label: np.ndarray, rng: np.random.Generator) -> Windows:
    """Some secrets with their value drawn anew; some others in capitals or as numbers; some windows of either label with the surroundings of another one."""
    flat = w.flat.copy()
    n = len(label)
    redraw, hide = rng.random(n) < 0.5, rng.random(n) < 0.5
    space = np.uint8(ord(" ") - 31)
    shape = rng.random(n)
    for i in np.flatnonzero(~label & (shape < 0.4)).tolist():
        a, b = w.cut[i, 1:3]
        own = flat[a:b]
        if shape[i] < 0.2:
            own[(own >= 66) & (own < 92)] -= 32  # the classes of a to z become those of A to Z
        else:
            own[:] = rng.integers(17, 27, b - a)  # 0 to 9
    for i in np.flatnonzero(redraw & label).tolist():
        a, b = w.cut[i, 1:3]
        flat[a:b] = rng.choice(_ALPHABETS[rng.integers(len(_ALPHABETS))], b - a)
    for i in np.flatnonzero(hide).tolist():
        begin, a, b, end = w.cut[i]
        j = int(rng.integers(n))
        if label[j]:
            flat[begin:a] = flat[b:end] = space
            continue
        o = w.cut[j]
        before, behind = w.flat[o[0] : o[1]], w.flat[o[2] : o[3]]
        flat[begin:a] = np.concatenate((np.full(max(0, a - begin - len(before)), space), before))[-(a - begin) :] if a > begin else before[:0]
        flat[b:end] = np.concatenate((behind, np.full(max(0, end - b - len(behind)), space)))[: end - b]
    return Windows(flat, w.cut)


def _platt(scored: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic calibration of the scores ``secret, shown``, by Newton's method with halved steps and smoothed targets; sums over
    all scores are made where they are, for all halves at once."""
    got = scored.agg(F.count_if("secret").alias("pos"), F.count_if(~F.col("secret")).alias("neg"), F.stddev_pop("shown").alias("spread")).first()
    pos, neg, spread = got.pos, got.neg, got.spread or 1.0
    z, target = F.col("shown") / spread, F.when(F.col("secret"), (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    exact = lambda x: F.sum((x * 2.0**40).cast("decimal(38,0)")).cast("double") / 2.0**40  # noqa: E731  (whole numbers: the same in any order)

    def loss(a: float, b: float) -> Column:
        y = a * z + b
        return exact(F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y))) - target * y)

    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + F.exp(-(a * z + b)))
        w = p * (1 - p)
        g1, g2, h11, h12, h22 = scored.agg(*[exact(x) for x in ((p - target) * z, p - target, w * z * z, w * z, w)]).first()
        da, db = np.linalg.solve([[h11 + 1e-9, h12], [h12, h22 + 1e-9]], [g1, g2])
        sizes = [0.5**k for k in range(20)]
        now, *then = scored.agg(loss(a, b), *[loss(float(a - s * da), float(b - s * db)) for s in sizes]).first()
        size = next((s for s, x in zip(sizes, then, strict=True) if x < now), 0.0)
        a, b = float(a - size * da), float(b - size * db)
        if not size or max(abs(da), abs(db)) < 1e-8:
            break
    return max(a / spread, 1e-6), b


def labelled(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """``secret, seen, a, b``: all candidates, ``seen`` being the classes of the candidate (of a rule's finding: its value) from ``a`` to ``b`` with its
    surroundings; with ``sample`` so many of each label at most, in order of a hash. What is seen alike, as in copies of a document, is one candidate.
    """

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for text in text_list(batch):
                found = rule_spans(text)
                spans = [(True, *value_span(text, *f)) for f in found] + [(False, *s) for s in candidate_spans(text, found)]
                if spans:
                    c = codes(text)
                    for secret, a, b in dict.fromkeys(spans):
                        lo, hi = max(0, a - SIDE), min(len(c), b + SIDE)
                        out.append((secret, c[lo:hi].tobytes(), a - lo, b - lo))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.bool_(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["secret", "seen", "a", "b"]
            )

        return step

    found = docs.where("text is not null").select("text").mapInArrow(over_batches(start), "secret boolean, seen binary, a int, b int").distinct()
    if sample is None:
        return found
    take = lambda which: found.where(which).orderBy(F.xxhash64("seen", "a", "b"), "seen").limit(sample)
    return take(F.col("secret")).unionByName(take(~F.col("secret")))


def fit(docs: DataFrame, sample: int | None = None, recall: float = 0.99) -> Network | None:
    """The network of :func:`train` on the :func:`labelled` candidates of ``docs`` (``text``); None where these lack a label."""
    return train(labelled(docs, sample), recall)


FOUND = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find_secrets(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, found`` for each row of ``docs`` (``doc_id, text``): the spans by start, then kind as in ``KINDS``.

    ``kind`` is the rule's name, or ``model`` for a candidate that no rule names and that the network's calibrated probability
    puts at its threshold or above; ``start`` and ``end`` count code points, ``end`` exclusive; ``score`` is that probability,
    for a rule's finding that of its value. A null text counts as empty and has none; texts are read whole; repeated rows are
    judged alike; other columns play no part; an empty table gives no rows. Without a network (None) there are the rules' findings, of score 1.
    """

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, rows = text_list(batch), []
            for lo, hi in blocks(texts):
                found = [rule_spans(t) for t in texts[lo:hi]]
                values = [[value_span(t, *f) for f in x] for t, x in zip(texts[lo:hi], found, strict=True)]
                others = [candidate_spans(t, x) if net is not None else [] for t, x in zip(texts[lo:hi], found, strict=True)]
                asked = [a + b for a, b in zip(values, others, strict=True)]
                score = iter([1.0] * sum(map(len, asked)) if net is None else net.probability(Windows.of([codes(t) if x else None for t, x in zip(texts[lo:hi], asked, strict=True)], asked)).tolist())
                for t, x, y in zip(texts[lo:hi], found, others, strict=True):
                    spans = [(a, b, k, next(score)) for a, b, k in x]
                    spans += [(a, b, len(RULES), p) for a, b in y if (p := next(score)) >= net.threshold]
                    spans.sort(key=lambda s: (s[0], s[2]))
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "value": t[a:b], "score": p} for a, b, k, p in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, found {FOUND}")


def spelled(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
