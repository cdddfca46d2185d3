"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words (lower case, without punctuation at their ends) and their prefixes of 4, 5 and 6
letters, hashed. A score is the logistic of a bias, a weight for each term, and the inner products of the terms' factor
vectors for each pair of terms: so a pair, such as an insult and the mention of a group, can weigh more than its parts.

The machine is trained in one task on a bounded sample of labelled rows (``per_class`` of each label, in order of a
hash of doc_id), on the terms that tell the labels apart on it: by themselves (chi square), or in a pair, where the
share of toxic rows with both terms isn't what those with one and with neither add up to. So a pair that says what
neither of its terms does keeps both. These are tests of significance; no number of terms is fixed. All documents are
scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.tokens import ragged

BUCKETS, PREFIXES, PER_CLASS, FACTORS = 1 << 22, (4, 5, 6), 4000, 8
LEAST_ROWS, LEAST_CHI2, PAIR_SHARE, LEAST_Z, EPOCHS, BATCH, THRESHOLD = 5, 12.0, 0.05, 8.0, 24, 256, 0.7
EDGES = ".,;:!?\"'()[]{}<>|*_-%&#"


def word_terms(word: str) -> list[int]:
    """Hashed terms of one word."""
    from xxhash import xxh32_intdigest

    word = word.strip(EDGES).lower()
    if not word:
        return []
    parts = [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxh32_intdigest(p) % BUCKETS for p in parts]


def batches_of_terms(texts: pa.Array, part: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some megabytes of texts at a time: words of each text, numbers of its words, and the terms of each numbered word (flat, sizes)."""
    texts = texts.fill_null("").cast(pa.large_string())
    total = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + part, side="right")))
        words = pc.ascii_split_whitespace(texts.slice(at, stop - at))
        coded = words.flatten().dictionary_encode()
        terms = [word_terms(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(t) for t in terms], np.int64)
        yield np.diff(np.asarray(words.offsets)), coded.indices.to_numpy(), np.array([x for t in terms for x in t], np.int64), sizes
        pa.default_memory_pool().release_unused()
        at = stop


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1; an empty text has the bias alone."""
        out = []
        for counts, numbers, flat, sizes in batches_of_terms(texts):
            at = np.minimum(np.searchsorted(self.terms, flat), max(0, len(self.terms) - 1))
            known = self.terms[at] == flat if len(self.terms) else np.zeros(len(flat), bool)
            own = np.add.reduceat(np.append(known, False).astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0) if len(sizes) else sizes
            doc = np.repeat(np.arange(len(counts)), counts)
            some = own[numbers] > 0
            found, n = ragged(at[known], own, numbers[some])
            pairs = np.unique(np.repeat(doc[some], n) * len(self.terms) + found) if len(self.terms) else np.zeros(0, np.int64)
            row, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
            linear = np.bincount(row, self.weights[term], len(counts))
            crossed = np.zeros(len(counts))
            for f in self.factors.T:
                crossed += np.bincount(row, f[term], len(counts)) ** 2 - np.bincount(row, f[term] ** 2, len(counts))
            out.append(1.0 / (1.0 + np.exp(-np.clip(self.bias + linear + crossed / 2, -60, 60))))
        return np.concatenate(out) if out else np.zeros(0)


RATE, SPREAD, DECAY_W, DECAY_V = 0.02, 0.02, 1e-5, 1e-4


class _Batch:
    """Some rows of term numbers, laid out for sums by row and by term."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        sizes = np.array([len(r) for r in rows])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        self.terms, self.at = np.unique(np.concatenate(rows), return_inverse=True)
        self.at = self.at.astype(np.int32)
        self.n = len(rows)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x[self.at], self.n)

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, x[self.row], len(self.terms))


def telling(numbered: list[np.ndarray], labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which terms tell the labels apart, alone or in a pair of terms that ``PAIR_SHARE`` of the rows have each."""
    n, positive = len(numbered), labels.sum()
    flat, y = np.concatenate(numbered), np.repeat(labels, [len(r) for r in numbered])
    toxic = np.bincount(flat, y, len(counts))
    a, b = toxic, counts - toxic
    c, d = positive - a, n - positive - b
    good = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9) >= LEAST_CHI2
    often = np.flatnonzero((counts >= max(LEAST_ROWS, PAIR_SHARE * n)) & (counts <= n - LEAST_ROWS))
    place = np.full(len(counts), -1, np.int64)
    place[often] = np.arange(len(often))
    x = np.zeros((n, len(often)), np.uint8)
    for i, r in enumerate(numbered):
        own = place[r]
        x[i, own[own >= 0]] = 1
    rows, sick, side = counts[often].astype(np.float32), toxic[often].astype(np.float32), 512

    def rate(k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = (k + 1) / (m + 2)
        return p, p * (1 - p) / np.maximum(m, 1)

    for s in range(0, len(often), side):
        one = x[:, s : s + side].astype(np.float32)
        ill_one = one * labels[:, None].astype(np.float32)
        for u in range(s, len(often), side):
            other = x[:, u : u + side].astype(np.float32)
            both, ill = one.T @ other, ill_one.T @ other
            a, b, ya, yb = rows[s : s + side, None], rows[None, u : u + side], sick[s : s + side, None], sick[None, u : u + side]
            cells = [(ill, both), (ya - ill, a - both), (yb - ill, b - both), (positive - ya - yb + ill, n - a - b + both)]
            (p11, v11), (p10, v10), (p01, v01), (p00, v00) = (rate(k, m) for k, m in cells)
            z = np.abs(p11 - p10 - p01 + p00) / np.sqrt(v11 + v10 + v01 + v00)
            z[np.minimum.reduce([m for _, m in cells]) < LEAST_ROWS] = 0
            good[often[s : s + side]] |= z.max(1) >= LEAST_Z
            good[often[u : u + side]] |= z.max(0) >= LEAST_Z
    return good


def train(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 0) -> Machine:
    """Fit to rows of distinct terms by Adam on the logistic loss in small batches.

    Without rows of both labels there is nothing to tell apart: every score is 0.5 then.
    """
    positive = int(labels.sum())
    if positive in (0, len(rows)):
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    seen, counts = np.unique(np.concatenate(rows), return_counts=True)
    seen, counts = seen[counts >= LEAST_ROWS].astype(np.int64), counts[counts >= LEAST_ROWS]

    def numbers(of: np.ndarray) -> list[np.ndarray]:
        at = [np.minimum(np.searchsorted(of, r), max(0, len(of) - 1)) for r in rows]
        return [a[of[a] == r].astype(np.int32) if len(of) else np.zeros(0, np.int32) for a, r in zip(at, rows, strict=True)]

    seen = seen[telling(numbers(seen), labels, counts)]
    numbered = numbers(seen)
    rng = np.random.default_rng(seed)
    batches = [_Batch([numbered[i] for i in part], labels[part]) for part in np.array_split(rng.permutation(len(rows)), -(-len(rows) // BATCH))]
    w, v, bias = np.zeros(len(seen)), rng.normal(0, SPREAD, (factors, len(seen))), 0.0
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    bias_moments, step = [0.0, 0.0], 0

    def move(grad, first, second, rate):
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        return rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), first, second

    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            b, step = batches[i], step + 1
            own, wv = v[:, b.terms], w[b.terms]
            sums = [b.by_row(f) for f in own]
            crossed = sum(s * s for s in sums) - b.by_row((own * own).sum(0))
            logit = bias + b.by_row(wv) + crossed / 2
            g = (1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))) - b.labels) / b.n
            gw = b.by_term(g)
            gv = np.stack([b.by_term(g * s) for s in sums]) - own * gw + DECAY_V * own
            change, bias_moments[0], bias_moments[1] = move(g.sum(), *bias_moments, RATE)
            bias -= change
            for x, first, second, grad in ((w, moments[0], moments[1], gw + DECAY_W * wv), (v, moments[2], moments[3], gv)):
                change, m, s = move(grad, first[..., b.terms], second[..., b.terms], RATE)
                first[..., b.terms], second[..., b.terms] = m, s
                x[..., b.terms] -= change
    return Machine(seen, float(bias), w, v.T.copy())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Train on at most ``per_class`` documents of each label, none of the held-out third.

    A doc_id labelled twice counts as toxic if once; one that several documents have stands for the least text of them.
    Null labels and doc_ids take no part. Without labels, or with labels of one class alone, every score is 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic_"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    drawn = [known.where(F.col("toxic_") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(drawn[0].union(drawn[1]).withColumnRenamed("doc_id", "id_"))  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("id_"))
    rows = rows.groupBy("id_").agg(F.max("toxic_").alias("toxic_"), F.min("text").alias("text")).select("toxic_", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for counts, numbers, flat, sizes in batches_of_terms(batch.column(1)):
                found, n = ragged(flat, sizes, numbers)
                ends = np.concatenate([[0], np.cumsum(n)])
                stops = np.cumsum(counts)
                out += [np.unique(found[ends[e - c] : ends[e]]).astype("<i4").tobytes() for c, e in zip(counts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(out, pa.binary())], names=["y", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        made = train([np.frombuffer(b, "<i4") for _, b in got], np.array([y for y, _ in got], float))
        parts = (made.terms.astype("<i8"), made.weights.astype("<f8"), made.factors.astype("<f8"))
        yield pa.RecordBatch.from_arrays([pa.array([made.bias]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["bias", "terms", "weights", "factors"])

    # the sample goes to one task, and only the machine to the driver
    made = rows.mapInArrow(terms, "y int, terms binary").repartition(1).mapInArrow(learn, "bias double, terms binary, weights binary, factors binary").collect()
    if not made:
        return train([], np.zeros(0))
    known, weights = np.frombuffer(made[0]["terms"], "<i8"), np.frombuffer(made[0]["weights"], "<f8")
    return Machine(known, made[0]["bias"], weights, np.frombuffer(made[0]["factors"], "<f8").reshape(len(known), -1) if len(known) else np.zeros((0, FACTORS)))


def _scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """row_ (the row of ``docs`` as a struct) and toxicity."""
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError("column names of documents must differ")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    shape = docs.select(row).schema["row_"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), "text").cast(pa.string())  # a text travels once, with its row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(texts), pa.float64())], names=["row_", "toxicity"])

    return docs.select(row).mapInArrow(run, f"row_ {shape}, toxicity double")


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), in place of a column of that name.

    Null texts are empty; long texts are scored whole; repeated rows score alike; an empty table gives none; other columns
    pass through.
    """
    return _scored(docs, machine).select(*[F.col(f"row_.`{c}`") for c in docs.columns if c != "toxicity"], "toxicity")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    made = score(docs.select("doc_id", "text"), fit(docs, labels))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns. All stay where the labels tell nothing apart (:func:`fit`)."""
    return _scored(docs, fit(docs, labels)).where(F.col("toxicity") < THRESHOLD).select("row_.*")
