"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded from two hashed bags, of its words and of their
shapes (first and last character classes and length), by a learned layer; gated attention learned from the document labels
weighs the passages, and the weighted sum is scored:

    h = tanh(x W + c),  a = softmax over passages of w . (tanh(h V) * sigmoid(h U)),  score = sigmoid(z . sum(a h) + b)

It is trained on the driver from a bounded sample of labelled rows (samples.ROWS_PER_LABEL a label, SAMPLE_BYTES in all)
outside the held-out fold, weighted so that both labels count alike and then shifted back to the labels' rates among all
labelled rows outside that fold; every whole text of the documents is scored, one pass without shuffle.

Defined cases: null or empty text: one passage without words. Repeated rows each get a row. No labelled rows, or of one
label only: a constant score (0.5, or near that label). Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .samples import folded, label_counts, labelled

FOLDS, HELD_OUT, CUT = 3, 1, 0.5
PASSAGE, BAG, HIDDEN = 64, 512, 16
EPOCHS, RATE, DECAY = 120, 0.02, 1e-4


def _shapes() -> np.ndarray:
    """Bytes to classes: letters a or A, digits 0, bytes over 0x7F a, others themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B], table[0x61:0x7B], table[0x30:0x3A], table[0x80:] = 0x41, 0x61, 0x30, 0x61
    return table


def passages(column):
    """Yields (bags of all passages in a slice, first passage of each of its texts and the end)."""
    wordy, shape, lower, half = K.blank_separated(), _shapes(), K.lower_table(), BAG // 2
    for _, _, data, offsets in K.chunks(column):
        starts, ends = K.word_spans(data, wordy)
        bounds = np.searchsorted(starts, offsets)
        n = np.diff(bounds)
        per = np.maximum(1, -(-n // PASSAGE))
        first = np.concatenate(([0], np.cumsum(per)))
        doc = np.repeat(np.arange(len(n)), n)
        passage = first[doc] + (np.arange(len(starts)) - bounds[doc]) // PASSAGE
        words = K.word_hashes(lower[data], starts, ends) % np.uint64(half)
        look = shape[data]
        last = np.maximum(starts, ends - 3)
        length = np.minimum((ends - starts) // 4, 7).astype(np.uint64)
        form = K.mix(K.word_hashes(look, last, ends) * K.STEP + look[starts].astype(np.uint64) + (length << np.uint64(8))) % np.uint64(half)
        total = int(first[-1]) * BAG
        counts = np.bincount(passage * BAG + words.astype(np.int64), minlength=total)
        counts += np.bincount(passage * BAG + half + form.astype(np.int64), minlength=total)
        bags = np.sqrt(counts.reshape(-1, BAG).astype(np.float32))
        bags /= np.maximum(np.sqrt((bags * bags).sum(axis=1, keepdims=True)), 1)
        yield bags, first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, bags: np.ndarray, first: np.ndarray) -> dict:
    at, doc = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(bags @ m["W"] + m["c"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, at)[doc])
    a = e / np.add.reduceat(e, at)[doc]
    z = np.add.reduceat(a[:, None] * h, at)
    return {"doc": doc, "at": at, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["z"] + m["b"] + m.get("shift", 0.0))}


def _gradients(m: dict, bags: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = forward(m, bags, first)
    doc, h, a = f["doc"], f["h"], f["a"]
    d = (f["p"] - y) * weight
    dz = d[:, None] * m["z"]
    pull = (dz[doc] * h).sum(axis=1)
    de = a * (pull - np.add.reduceat(a * pull, f["at"])[doc])
    dtg = de[:, None] * m["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (a[:, None] * dz[doc] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h**2)
    out = {"W": bags.T @ dh, "c": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de, "z": f["z"].T @ d, "b": d.sum()}
    return {k: v + DECAY * m[k] for k, v in out.items()}


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, counts: tuple[int, int] = (1, 1)) -> dict:
    """The model of (text, label) rows; counts: how many rows have label 0 and 1 where the scores are to hold."""
    rng = np.random.default_rng(7)
    m = {k: rng.normal(0, s, n).astype(np.float32) for k, s, n in (("W", 0.3, (BAG, HIDDEN)), ("V", 0.3, (HIDDEN, HIDDEN)), ("U", 0.3, (HIDDEN, HIDDEN)), ("w", 0.3, HIDDEN), ("z", 0.3, HIDDEN))}
    m |= {"c": np.zeros(HIDDEN, np.float32), "b": 0.0}
    y = np.array([float(v) for _, v in rows])
    if len(set(y)) < 2:
        m["z"][:] = 0
        m["b"] = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return m
    parts = list(passages(pa.array([t for t, _ in rows], pa.string())))
    bags = np.concatenate([b for b, _ in parts])
    size = np.concatenate([np.diff(f) for _, f in parts])
    first = np.concatenate(([0], np.cumsum(size)))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    mean, var = {k: 0.0 for k in m}, {k: 0.0 for k in m}
    for step in range(1, epochs + 1):
        for k, g in _gradients(m, bags, first, y, weight).items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            m[k] = m[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    m["shift"] = np.log(max(counts[1], 1) / max(counts[0], 1))
    return {k: np.asarray(v, dtype=np.float32) for k, v in m.items()}


def score(column, model: dict) -> np.ndarray:
    parts = [forward(model, bags, first)["p"] for bags, first in passages(column)]
    return np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)


def classify_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(labelled(documents, labels, "quality", FOLDS, HELD_OUT), counts=label_counts(labels, "quality", FOLDS, HELD_OUT))

    def each(batches):
        for b in batches:
            p = score(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return folded(documents, FOLDS, HELD_OUT).mapInArrow(each, f"doc_id {kind}, held_out boolean, score double, predicted int")
