"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings of STEMS bytes (lower-cased, hashed into BUCKETS; stems stand
for forms that no sample has), each scaled by the log-ratio of its rates in toxic and other sample texts; words in fewer than
LEAST_DOCS sample texts are left out. Logistic weights are learned with a penalty besides the usual one, over pairs of
sentences that differ in identity terms only:

* each sentence of a labelled text that has identity terms (whole words; at most SENTENCES of them, by a hash), with every
  term swapped for another of its kind, SWAPS times, and with its terms left out;
* for each identity term MENTIONS labelled sentences without any, with the term put in, so that a neutral mention is held
  to no change even where the sample has none.

PENALTY times the mean squared change of the score before the sigmoid is added to the loss, so naming a group does not move a
score. swap_gap() measures what is left of it.

It is trained on the driver from a bounded sample of labelled rows outside the held-out fold (samples.ROWS_PER_LABEL a
label, SAMPLE_BYTES in all); every whole text is scored in one pass without shuffle.

Defined cases: null or empty text: the score of no words. Repeated rows each get a row. No labelled rows, or of one label
only: a constant score. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .samples import folded, labelled

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
BUCKETS, LEAST_DOCS, SUPPORT, STEMS = 1 << 20, 5, 10, (4,)
EPOCHS, RATE, DECAY, PENALTY = 150, 0.1, 1e-3, 5.0
SENTENCES, SWAPS, MENTIONS = 20_000, 3, 4
# Identity terms by kind; those of a kind are swapped for one another.
IDENTITY = {
    "gender": "women men girls boys",
    "person": "woman man girl boy",
    "believers": "muslims christians jews hindus buddhists atheists",
    "belief": "muslim christian jewish hindu buddhist atheist",
    "newcomers": "immigrants refugees foreigners natives",
    "origin": "black white asian african european american latino arab",
    "orientation": "gay lesbian bisexual straight transgender",
    "age": "old young elderly",
    "condition": "disabled deaf blind",
    "means": "poor rich",
    "geschlecht": "frauen männer",
    "religion": "juden muslime christen",
    "sexe": "femmes hommes",
    "croyance": "juifs musulmans chrétiens",
    "sexo": "mujeres hombres",
    "creencia": "judíos musulmanes cristianos",
}
KIND = {term: kind for kind, terms in IDENTITY.items() for term in terms.split()}
TERM = re.compile(r"(?<![0-9A-Za-z\x80-\U0010ffff])(?:%s)(?![0-9A-Za-z\x80-\U0010ffff])" % "|".join(sorted(KIND, key=len, reverse=True)), re.I | re.A)
SENTENCE = re.compile(r"[.!?\n]+")


def word_sets(column):
    """Yields for each text its sorted distinct word buckets."""
    lower, wordy = K.lower_table(), K.alphanumeric()
    for i, j, data, offsets in K.chunks(column):
        data = lower[data]
        starts, ends = K.word_spans(data, wordy)
        bounds = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        keys = []
        for n in (0, *STEMS):
            long = np.flatnonzero(ends - starts > n) if n else slice(None)
            h = K.word_hashes(data, starts[long], starts[long] + n if n else ends)
            keys.append(doc[long] * BUCKETS + (K.mix(h + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        keys = np.unique(np.concatenate(keys))
        yield keys % BUCKETS, np.searchsorted(keys, np.arange(j - i + 1) * BUCKETS)


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' buckets, and where each text's begin."""
    parts = list(word_sets(pa.array(texts, pa.string())))
    size = np.concatenate([np.diff(b) for _, b in parts]) if parts else np.zeros(0, np.int64)
    return (np.concatenate([a for a, _ in parts]) if parts else np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum(size)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _number(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def sentence_pairs(texts: list[str]) -> list[tuple[str, str]]:
    """(sentence, the same with other identity terms, with none, or with one put in)."""
    named, plain = {}, {}
    for text in texts:
        for s in SENTENCE.split(text):
            if TERM.search(s):
                named[s] = _number(s)
            elif len(plain) < SENTENCES and s.strip():
                plain[s] = _number(s)
    out = []
    for s in sorted(named, key=lambda x: (named[x], x))[:SENTENCES]:
        rng = np.random.default_rng(named[s])

        def other(m):
            term = m[0].lower()
            return rng.choice([t for t in IDENTITY[KIND[term]].split() if t != term])

        out += [(s, TERM.sub(other, s)) for _ in range(SWAPS)] + [(s, TERM.sub(" ", s))]
    neutral = sorted(plain, key=lambda x: (plain[x], x))
    for k, term in enumerate(KIND):
        out += [(s, f"{term} {s}") for s in neutral[k * MENTIONS : (k + 1) * MENTIONS] or neutral[:MENTIONS]]
    return out


def _changes(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair the buckets that only one sentence has: pair, bucket, -1 (the first has it) or 1."""
    one, two = (_sets([p[k] for p in pairs]) for k in (0, 1))
    keys = [np.repeat(np.arange(len(pairs)), np.diff(b)) * BUCKETS + a for a, b in (one, two)]
    gone, come = np.setdiff1d(*keys, assume_unique=True), np.setdiff1d(*keys[::-1], assume_unique=True)
    both = np.concatenate((gone, come))
    return both // BUCKETS, both % BUCKETS, np.repeat([-1.0, 1.0], [len(gone), len(come)])


class Sample:
    """Labelled texts as buckets, and the pairs' changes, for the loss."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.y = y = np.array([float(v) for _, v in rows])
        self.sets, self.bounds = _sets([t for t, _ in rows])
        self.doc = np.repeat(np.arange(len(y)), np.diff(self.bounds))
        self.weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
        seen = np.bincount(self.sets, minlength=BUCKETS)
        toxic = np.bincount(self.sets, weights=y[self.doc], minlength=BUCKETS)
        ratio = np.log((toxic + 1) / (y.sum() + 2)) - np.log((seen - toxic + 1) / (len(y) - y.sum() + 2))
        self.scale = np.where(seen >= LEAST_DOCS, ratio * seen / (seen + SUPPORT + 1e-9), 0.0)  # rare words count for less
        pairs = sentence_pairs([t for t, _ in rows])
        self.pairs = max(len(pairs), 1)
        self.pair, self.bucket, sign = _changes(pairs) if pairs else (np.zeros(0, np.int64),) * 3
        used = np.flatnonzero(self.scale[self.bucket])  # the others never move a score
        self.pair, self.bucket, self.sign = self.pair[used], self.bucket[used], sign[used] * self.scale[self.bucket[used]]
        self.x = self.scale[self.sets]

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """The loss, and its gradient by weights and bias."""
        s = _sums(self.x * w[self.sets], self.bounds) + b
        p = _sigmoid(s)
        d = (p - self.y) * self.weight
        g = np.bincount(self.sets, weights=self.x * d[self.doc], minlength=BUCKETS) + DECAY * w
        moved = np.bincount(self.pair, weights=self.sign * w[self.bucket], minlength=self.pairs)
        g += np.bincount(self.bucket, weights=self.sign * (2 * PENALTY / self.pairs * moved)[self.pair], minlength=BUCKETS)
        fit = -(self.weight * (self.y * np.log(p) + (1 - self.y) * np.log(1 - p))).sum()
        return float(fit + DECAY / 2 * (w * w).sum() + PENALTY * (moved * moved).sum() / self.pairs), g, float(d.sum())


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the bias."""
    y = np.array([float(v) for _, v in rows])
    if len(set(y)) < 2:
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    sample = Sample(rows)
    w, b = np.zeros(BUCKETS), 0.0
    mean, var, mean_b, var_b = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, epochs + 1):
        _, g, d = sample.loss(w, b)
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        mean_b, var_b = 0.9 * mean_b + 0.1 * d, 0.99 * var_b + 0.01 * d**2
        w = w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        b = b - RATE * (mean_b / (1 - 0.9**step)) / (np.sqrt(var_b / (1 - 0.99**step)) + 1e-8)
    return (w * sample.scale).astype(np.float32), float(b)


def swap_gap(texts: list[str], model: tuple[np.ndarray, float]) -> float:
    """The mean change of the score over the texts that have identity terms, with each swapped for the next of its kind."""

    def after(m):
        terms = IDENTITY[KIND[m[0].lower()]].split()
        return terms[(terms.index(m[0].lower()) + 1) % len(terms)]

    named = [t for t in texts if TERM.search(t)]
    if not named:
        return 0.0
    one, two = (score(pa.array(x, pa.string()), model) for x in (named, [TERM.sub(after, t) for t in named]))
    return float(np.abs(one - two).mean())


def score(column, model: tuple[np.ndarray, float]) -> np.ndarray:
    table, bias = model
    parts = [_sigmoid(_sums(table[a].astype(np.float64), bounds) + bias) for a, bounds in word_sets(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def classify_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(labelled(documents, labels, "toxic", FOLDS, HELD_OUT))

    def each(batches):
        for b in batches:
            p = score(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return folded(documents, FOLDS, HELD_OUT).mapInArrow(each, f"doc_id {kind}, held_out boolean, score double, predicted int")
