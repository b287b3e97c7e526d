"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the embedding of its hash next to the mean embedding of its hashed
character trigrams, so that new forms of known stems are recognised.  A text is read in
windows of ``WINDOW`` words, each overlapping the next by half; every window of the whole
text is scored, and the text's score is that of its most toxic window, calibrated.

Training is numpy on the driver, on a bounded sample of labelled documents.  Labels belong to
documents, not windows, so each round trains on the window of each document that the network
finds most toxic so far.  Scoring is one map over the documents with the model (under
1 MB) in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import batch, grouped, logistic, map_rows, raw_text, rows, sample_per_class, sigmoid

WINDOW, STRIDE = 48, 24
PIECE = 24  # bytes of a word's input; longer words are several inputs
WORDS, GRAMS, SIZE, HIDDEN, ATTENTION = 1 << 14, 1 << 12, 8, 8, 8
SAMPLE_DOCS = 2_000
SAMPLE_WINDOWS = 16  # of one training document, spread over it

#: A-Z to a-z; digits, a-z and bytes of 0x80 or more as they are; all else a space.
INPUT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_windows", pa.int64())])
OUT_SQL = "doc_id long, held_out boolean, score double, n_windows long"


def words_of(text: bytes) -> list[bytes]:
    words = text.translate(INPUT).split()
    if text and max(map(len, words), default=0) > PIECE:
        words = [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def window_starts(n: int) -> list[int]:
    """Starts of the windows of a text of ``n`` words; the last one ends where the text ends."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


def inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word bucket, trigram buckets) of each word; 0 stands for no trigram."""
    n = len(words)
    mat = np.zeros((n, PIECE + 2), np.uint32)
    mat[:, 0] = 94
    mat[:, 1:-1] = np.array(words, f"S{PIECE}").view(np.uint8).reshape(n, PIECE)
    size = np.fromiter(map(len, words), np.int64, n)
    mat[np.arange(n), size + 1] = 36
    h = mat[:, :-2] * np.uint32(0x9E3779B1) ^ mat[:, 1:-1] * np.uint32(0x85EBCA77) ^ mat[:, 2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
    on = np.arange(PIECE) < size[:, None]
    whole = (np.where(on, h * (2 * np.arange(PIECE, dtype=np.uint32) + 3), 0).sum(1, dtype=np.uint64) >> np.uint64(5)) % np.uint64(WORDS)
    return whole.astype(np.int64), np.where(on, (h >> np.uint32(7)) % np.uint32(GRAMS - 1) + 1, 0).astype(np.int32)


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    calibration: np.ndarray  # of (largest logit, log number of windows)

    def score(self, top: np.ndarray, n_windows: np.ndarray) -> np.ndarray:
        return sigmoid(top * self.calibration[0] + np.log(n_windows) * self.calibration[1] + self.calibration[2])


def start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    return {"word": r.normal(0, 0.1, (WORDS, SIZE)).astype(np.float32), "gram": r.normal(0, 0.3, (GRAMS, SIZE)).astype(np.float32),
            "wx": f(2 * SIZE, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32),
            "u0": f(HIDDEN, 3 * HIDDEN), "u1": f(HIDDEN, 3 * HIDDEN),
            "wa": f(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": f(ATTENTION, 1)[:, 0],
            "wo": f(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1, np.float32)}


def embed(w: dict, ids: np.ndarray, grams: np.ndarray) -> np.ndarray:
    n = np.maximum((grams > 0).sum(1, keepdims=True), 1)
    chars = np.zeros((len(ids), SIZE), np.float32)
    for k in range(grams.shape[1]):
        g = grams[:, k]
        if not g.any():
            break
        chars += w["gram"][g] * (g > 0)[:, None]
    return np.hstack([w["word"][ids], chars / n]).astype(np.float32)


def gate(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(x * np.float32(0.5)) + np.float32(1))


def forward(w: dict, p: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows.  ``p``: projected inputs (steps, windows, 6 HIDDEN); ``mask``: (steps,
    windows), 1 for a word.  With ``keep`` also what the backward pass needs."""
    steps, n, _ = p.shape
    out = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    trace = []
    full = bool(mask.all())
    for d in (0, 1):
        h, u = np.zeros((n, HIDDEN), np.float32), w[f"u{d}"]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x = p[t, :, 3 * HIDDEN * d:3 * HIDDEN * (d + 1)]
            hu = h @ u
            zr = gate(x[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            if not full:
                new = h + mask[t][:, None] * (new - h)
            if keep:
                trace.append((d, t, h, z, r, c, hu[:, 2 * HIDDEN:]))
            h = new
            out[t, :, HIDDEN * d:HIDDEN * (d + 1)] = h
    a = np.tanh(out @ w["wa"] + w["ba"])
    e = a @ w["va"]
    if not full:
        e = np.where(mask > 0, e, np.float32(-1e4))
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tn,tnh->nh", e, out)
    logit = pooled @ w["wo"] + w["bo"][0]
    return (logit, out, a, e, pooled, trace) if keep else logit


def backward(w: dict, kept: tuple, mask: np.ndarray, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights past the embeddings, and of the projected inputs."""
    _, out, a, e, pooled, trace = kept
    g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32), "u0": np.zeros_like(w["u0"]), "u1": np.zeros_like(w["u1"])}
    d_pooled = d_logit[:, None] * w["wo"]
    d_out = e[:, :, None] * d_pooled
    d_e = np.einsum("tnh,nh->tn", out, d_pooled)
    d_e = e * (d_e - (e * d_e).sum(0))
    g["va"] = np.einsum("tn,tnk->k", d_e, a)
    d_a = d_e[:, :, None] * w["va"] * (1 - a**2)
    g["ba"] = d_a.sum((0, 1))
    g["wa"] = np.einsum("tnh,tnk->hk", out, d_a)
    d_out += d_a @ w["wa"].T
    d_p = np.zeros((*out.shape[:2], 6 * HIDDEN), np.float32)
    d_h, last = None, None
    for d, t, h, z, r, c, hn in reversed(trace):
        if d != last:
            d_h, last = np.zeros_like(h), d
        total = d_h + d_out[t, :, HIDDEN * d:HIDDEN * (d + 1)]
        m = mask[t][:, None]
        d_new = total * m
        d_h = total * (1 - m) + d_new * z
        d_c = d_new * (1 - z) * (1 - c**2)
        d_z = d_new * (h - c) * z * (1 - z)
        d_r = d_c * hn * r * (1 - r)
        d_hu = np.hstack([d_z, d_r, d_c * r])
        d_p[t, :, 3 * HIDDEN * d:3 * HIDDEN * (d + 1)] = np.hstack([d_z, d_r, d_c])
        g[f"u{d}"] += h.T @ d_hu
        d_h = d_h + d_hu @ w[f"u{d}"].T
    return g, d_p


class Windows:
    """Windows of the training documents as rows of vocabulary numbers (0: no word)."""

    def __init__(self, docs: list[list[list[bytes]]]):
        vocabulary: dict[bytes, int] = {}
        data, self.bag = [], []
        for b, windows in enumerate(docs):
            for x in windows:
                numbers = [vocabulary.setdefault(v, len(vocabulary) + 1) for v in x]
                data.append(np.array(numbers + [0] * (WINDOW - len(x)), np.int32))
                self.bag.append(b)
        self.x, self.bag = np.array(data, np.int32), np.array(self.bag)
        words = [b"", *vocabulary]
        some = [inputs(words[i:i + 8192]) for i in range(0, len(words), 8192)]
        self.ids, self.grams = np.concatenate([a for a, _ in some]), np.concatenate([b.astype(np.int16) for _, b in some])

    def project(self, w: dict, x: np.ndarray):
        uniq, back = np.unique(x.T, return_inverse=True)
        e = embed(w, self.ids[uniq], self.grams[uniq])
        return uniq, back, e, (e @ w["wx"] + w["bx"])[back].reshape(*x.T.shape, -1)

    def logits(self, w: dict) -> np.ndarray:
        out = [forward(w, self.project(w, x)[-1], (x.T > 0).astype(np.float32)) for x in np.array_split(self.x, -(-len(self.x) // 2048))]
        return np.concatenate(out)

    def hints(self, y: np.ndarray) -> np.ndarray:
        """First guess of each window's logit: the largest log odds of a word or a trigram in it,
        by the documents that hold it."""
        n = [max(1, int((y == k).sum())) for k in (0, 1)]

        def odds(has: list[np.ndarray]) -> np.ndarray:
            return np.where(has[1] > 1, np.log((has[1] + 0.2) / n[1]) - np.log((has[0] + 0.2) / n[0]), -9)
        pairs = np.unique(self.x.astype(np.int64) * len(y) + self.bag[:, None])
        word, bag = pairs // len(y), pairs % len(y)
        own = odds([np.bincount(word[y[bag] == k], minlength=len(self.ids)) for k in (0, 1)])
        seen = np.zeros((GRAMS, len(y)), bool)
        for k in range(PIECE):
            seen[self.grams[word, k], bag] = True
        gram = odds([seen[:, y == k].sum(1) for k in (0, 1)])
        gram[0] = -9
        best = np.maximum(own, gram[self.grams].max(1))
        best[0] = -9
        return best[self.x].max(1)

    def tops(self, logits: np.ndarray) -> np.ndarray:
        """The row of each bag's largest logit."""
        by = np.lexsort((logits, self.bag))
        return by[np.flatnonzero(np.append(self.bag[by][1:] != self.bag[by][:-1], True))]


def train(windows: Windows, y: np.ndarray, seed: int = 7, size: int = 128, least_steps: int = 400, rounds: int = 8,
          more: int = 1, drop: float = 0.0, decay: float = 0.0) -> dict[str, np.ndarray]:
    """Adam on each bag's most toxic window (in the first two rounds by ``hints``) and on clean
    windows at random, optionally with dropped inputs and decaying embeddings."""
    w, r = start(seed), np.random.default_rng(seed)
    one, two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    bags = len(y)
    clean = np.flatnonzero(y[windows.bag] == 0)
    n_round = bags + min(len(clean), more * bags)
    rounds = max(rounds, -(-least_steps // -(-n_round // size)))
    total = rounds * -(-n_round // size)
    for k in range(rounds):
        logits = windows.logits(w) if k > 1 else windows.hints(y)
        chosen = np.concatenate([windows.tops(logits), r.permutation(clean)[:more * bags]])
        label = y[windows.bag[chosen]]
        weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(chosen)
        order = r.permutation(len(chosen))
        chosen, weight = chosen[order], weight[order]
        for at in range(0, len(chosen), size):
            rowset = chosen[at:at + size]
            x, bag = windows.x[rowset], windows.bag[rowset]
            mask = (x.T > 0).astype(np.float32)
            uniq, back, e, p = windows.project(w, x)
            off = (r.random(e.shape) > drop).astype(np.float32) / (1 - drop)
            e = e * off
            p = (e @ w["wx"] + w["bx"])[back].reshape(p.shape)
            kept = forward(w, p, mask, keep=True)
            d = ((sigmoid(kept[0]) - y[bag]) * weight[at:at + size] / len(x)).astype(np.float32)
            g, d_p = backward(w, kept, mask, d)
            d_proj = np.zeros((len(uniq), 6 * HIDDEN), np.float32)
            np.add.at(d_proj, back.ravel(), d_p.reshape(-1, 6 * HIDDEN))
            g["wx"], g["bx"] = e.T @ d_proj, d_proj.sum(0)
            d_e = d_proj @ w["wx"].T * off
            g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
            np.add.at(g["word"], windows.ids[uniq], d_e[:, :SIZE])
            grams = windows.grams[uniq]
            share = d_e[:, SIZE:] / np.maximum((grams > 0).sum(1, keepdims=True), 1)
            which, place = np.nonzero(grams)
            np.add.at(g["gram"], grams[which, place], share[which])
            step += 1
            rate = 0.01 * (1 - 0.9 * step / total)
            for name, v in w.items():
                gr = np.clip(g[name], -1, 1)
                one[name] += 0.1 * (gr - one[name])
                two[name] += 0.01 * (gr**2 - two[name])
                if name in ("word", "gram"):
                    v *= np.float32(1 - rate * decay)
                v -= (rate * one[name] / (1 - 0.9**step) / (np.sqrt(two[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = SAMPLE_DOCS, windows_per_doc: int = SAMPLE_WINDOWS) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1), all training rows.

    The network learns from at most ``docs_per_class`` documents of each label (smallest id hash), of
    each at most ``windows_per_doc`` windows spread evenly over it.  A fifth of the documents is kept for
    calibration: they are scored whole, as all texts are, and weighted to the labels' own shares.
    Of repeated ids one text counts, the least; empty tables, and tables without both labels, give
    the share of label 1 (0.5 without labels) as every score."""
    shares = {int(r["label"]): r["count"] for r in labels.where(F.col("label").isNotNull()).groupBy("label").count().collect()}
    pick = sample_per_class(labels, docs_per_class)
    use = docs.select("doc_id", raw_text().alias("text")).join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    use = use.select(F.col("doc_id").cast("long").alias("doc"), "text", F.col("label").cast("long").alias("label"), F.xxhash64(F.lit("order"), "doc_id").alias("at"))
    schema = pa.schema([("label", pa.int64()), ("at", pa.int64()), ("doc", pa.int64()), ("windows", pa.list_(pa.binary()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(row):
            doc, text, label, order = row
            words = words_of(text)
            starts = window_starts(len(words))
            few = [starts[i] for i in sorted(set(np.linspace(0, len(starts) - 1, min(len(starts), windows_per_doc)).astype(int).tolist()))]
            return label, order, doc, [b" ".join(words[s:s + WINDOW]) for s in few]
        for group in grouped(map(one, rows(batches)), lambda r: 100, 100_000):
            yield batch(schema, *zip(*group, strict=True))
    found = use.mapInArrow(cut, "label long, at long, doc long, windows array<binary>").collect()  # docs_per_class rows a label
    found.sort(key=lambda r: (r["at"], r["doc"], r["label"]))
    y = np.array([r["label"] for r in found], np.float32)
    if len(set(y.tolist())) < 2:
        share = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
        return Model(start(), np.array([0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))]))
    test = np.arange(len(y)) % 5 == 4
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test[:] = True
        w = train(Windows([[bytes(x).split() for x in r["windows"]] for r in found]), y)
    else:
        w = train(Windows([[bytes(x).split() for x in r["windows"]] for r, t in zip(found, test, strict=True) if not t]), y[~test])
    plain = docs.sparkSession.sparkContext.broadcast(Model(w, np.zeros(3)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plain.value)
        for group in grouped(rows(batches), lambda r: len(r[1]) + 400, 1 << 20):
            top, n = scorer([r[1] for r in group])
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in group], pa.int64()), pa.array(top.astype(float)), pa.array(n.astype(np.int64))], names=["label", "top", "n"])
    kept = docs.sparkSession.createDataFrame([(r["doc"],) for r, t in zip(found, test, strict=True) if t], "doc long")
    scored = use.join(F.broadcast(kept), "doc").select("doc", "text", "label").mapInArrow(whole, "label long, top double, n long").collect()
    plain.unpersist()
    y = np.array([r["label"] for r in scored], float)
    has = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, shares.get(1, 1) / has[1], shares.get(0, 1) / has[0])
    features = np.column_stack([[r["top"] for r in scored], np.log([r["n"] for r in scored])])
    return Model(w, logistic(features, y, decay=0.1, weight=weight / weight.mean()))


class Scorer:
    """Scores texts with a model; projected inputs of words are kept up to a bound."""

    def __init__(self, model: Model, most_words: int = 150_000):
        self.model, self.most = model, most_words
        self.reset()

    def reset(self):
        self.row: dict[bytes, int] = {b"": 0}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w = self.model.weights
        docs = [words_of(t) for t in texts]
        if len(self.row) > self.most:
            self.reset()
        fresh = list({v for d in docs for v in d if v not in self.row})
        if fresh:
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            new = [embed(w, *inputs(fresh[i:i + 8192])) @ w["wx"] + w["bx"] for i in range(0, len(fresh), 8192)]
            self.table = np.concatenate([self.table, *new])
        get = self.row.__getitem__
        flat = np.concatenate([np.fromiter(map(get, d), np.int64, len(d)) for d in docs] + [np.zeros(WINDOW, np.int64)])
        size = np.array([len(d) for d in docs])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        starts = [window_starts(n) for n in size.tolist()]
        n_windows = np.array([len(s) for s in starts])
        first = np.concatenate([a + np.array(s) for a, s in zip(at, starts, strict=True)])
        length = np.repeat(np.minimum(size, WINDOW), n_windows)
        logits = np.empty(len(first), np.float32)
        by = np.argsort(-length, kind="stable")  # full windows together, without masks
        full = int((length == WINDOW).sum())
        for lo, hi in [(i, min(i + 1024, full)) for i in range(0, full, 1024)] + [(i, min(i + 1024, len(by))) for i in range(full, len(by), 1024)]:
            k = by[lo:hi]
            steps = max(1, int(length[k].max()))
            mask = (np.arange(steps)[:, None] < length[k]).astype(np.float32)
            cells = flat[first[k] + np.arange(steps)[:, None]]
            logits[k] = forward(w, self.table[cells], mask)
        return np.maximum.reduceat(logits, np.concatenate([[0], np.cumsum(n_windows)[:-1]])), n_windows


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), n_windows of every row of ``docs`` (doc_id, text, held_out).

    A null, empty or wordless text is one window without words and gets the network's score of
    that.  Words longer than ``PIECE`` bytes are read in pieces, so nothing is skipped.  Repeated
    rows are each scored; ids may be null; an empty table gives an empty result; other columns are
    ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for group in grouped(rows(batches), lambda r: len(r[1]) + 400, 1 << 20):
            top, n = scorer([r[1] for r in group])
            yield batch(OUT, [r[0] for r in group], [r[2] for r in group], scorer.model.score(top, n).tolist(), n.tolist())
    return docs.select(F.col("doc_id").cast("long"), raw_text().alias("text"), "held_out").mapInArrow(work, OUT_SQL)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose ``text`` scores below ``threshold``, with all their columns."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            texts, keep = b.column(place).cast(pa.binary()).to_pylist(), []
            for group in grouped(iter(texts), lambda t: len(t or b"") + 400, 1 << 20):
                keep.extend((scorer.model.score(*scorer([t or b"" for t in group])) < threshold).tolist())
            yield b.filter(pa.array(keep, pa.bool_()))
    return map_rows(docs, work)
