"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms. Beside a weight, each term has a short vector, and the products of the vectors
of all pairs of terms add to the score, so a pair (an insult with the mention of a group) can count for more than its
terms do alone. The machine is fitted with AdaGrad on a bounded sample of labelled rows, on the terms that are most
associated with the label there, by themselves or beside another term; its weights (a few thousand short vectors) are
broadcast, and every whole text is scored where it is read.

Defined results: a null or empty text has no terms and scores the prior; a null label is no label, and of several labels
for a doc_id the largest counts; rows that repeat are each scored, alike, and the sample takes one text of a doc_id (that
whose terms have the least hash), so that it is bounded however often an id repeats; very long texts are scored whole; there
are no ties; without any labelled row the score is 0; a null doc_id is never held out; extra columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_or_null, draw, ship, table

#: Hash buckets, labelled rows in the sample (expected), terms that the machine knows, length of their vectors.
BUCKETS, SAMPLE, TERMS, FACTORS = 2**18, 16_384, 4_096, 4
#: The score from which a text is called toxic; the sampled documents that a term must be in, and its least z-score.
THRESHOLD, MIN_DOCS, MIN_Z = 0.3, 3, 4.0
#: Terms whose pairs are looked at: so many that part the sample most evenly, and the best quarter as many by themselves. A pair's
#: least z-score is higher, as there are millions of pairs.
PAIRED, PAIR_Z = 2_048, 7.0
#: Sampled texts whose pairs are counted at a time.
BLOCK = 1_024

#: Letters of a beginning that is a term, too (inflected and compound words).
STEMS = (6, 5, 4, 3)

_APART = str.maketrans(dict.fromkeys("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~…“”«»", " "))


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text, ascending: its words, and the beginnings of longer ones."""
    words = set((text or "").lower().translate(_APART).split())
    for n in STEMS:
        words |= {f"{w[:n]}-" for w in words if len(w) > n}
    return np.unique(np.array([zlib.crc32(w.encode()) % BUCKETS for w in words], dtype=np.int32))


@dataclass
class Machine:
    """``place`` gives a bucket's row in ``weights`` and ``vectors``, or -1."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = self.place[found]
        at = at[at >= 0]
        v = self.vectors[at]
        pairs = 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + pairs, -40, 40))))


def associated(docs: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """The buckets whose presence goes most with or against the label, by the z-score of the share of labelled texts, and those
    that do so in a pair."""
    both = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    y = np.repeat(labels.astype(np.float32), [len(d) for d in docs])
    n, hits = np.bincount(both, minlength=BUCKETS), np.bincount(both, weights=y, minlength=BUCKETS)
    p = labels.mean()
    z = np.abs(hits - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    z[n < MIN_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:most]
    alone = best[z[best] >= MIN_Z]
    even = np.argsort(-(n * (len(docs) - n)), kind="stable")[:PAIRED]
    looked = np.union1d(even[n[even] >= MIN_DOCS], alone[: PAIRED // 4])
    return np.union1d(alone, looked[paired(docs, labels, looked)])


def paired(docs: list[np.ndarray], labels: np.ndarray, looked: np.ndarray) -> np.ndarray:
    """Which of the ascending buckets ``looked`` are in a pair whose texts are labelled more or less often than the shares of its
    two terms add up to. Two terms may each be neutral and tell the label together."""
    m, p = len(looked), labels.mean() if len(labels) else 0.0
    n, hits = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    place = np.full(BUCKETS, -1, np.int32)
    place[looked] = np.arange(m)
    for wanted, sums in ((labels > 0, hits), (labels <= 0, n)):
        chosen = np.flatnonzero(wanted)
        for k in range(0, len(chosen), BLOCK):
            part = [place[docs[i]] for i in chosen[k : k + BLOCK]]
            has = np.zeros((len(part), m), np.float32)
            for row, at in zip(has, part):
                row[at[at >= 0]] = 1
            sums += has.T @ has
    n += hits
    share = np.diag(hits) / np.maximum(np.diag(n), 1)
    told = np.zeros(m, bool)
    for k in range(0, m, BLOCK):
        at = slice(k, k + BLOCK)
        most = np.maximum(n[at], 1)
        # an expected share of 0 or 1 would make any other outcome infinitely unlikely
        expected = np.clip(share[at, None] + share - p, 0.5 / most, 1 - 0.5 / most)
        z = np.abs(hits[at] - n[at] * expected) / np.sqrt(most * expected * (1 - expected))
        z[n[at] < MIN_DOCS] = 0
        z[np.arange(len(z)), np.arange(k, k + len(z))] = 0
        told[at] = (z >= PAIR_Z).any(1)
    return told


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = 3, epochs: int = 40, rate: float = 0.1, decay: float = 1e-4, batch: int = 256) -> Machine:
    """Logistic loss, AdaGrad, mini-batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    known = associated(docs, labels, TERMS)
    place = np.full(BUCKETS, -1, np.int64)
    place[known] = np.arange(len(known))
    rows = [place[d][place[d] >= 0] for d in docs]
    p = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = float(np.log(p / (1 - p))), np.zeros(len(known)), rng.normal(0, 0.02, (len(known), FACTORS))
    sum_b, sum_w, sum_v = 1e-2, np.full(len(known), 1e-2), np.full((len(known), FACTORS), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            size = np.array([len(rows[i]) for i in part])
            at, seg = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), size)
            own = v[at]
            total = np.stack([np.bincount(seg, own[:, f], len(part)) for f in range(FACTORS)], 1)
            squares = np.bincount(seg, np.einsum("ij,ij->i", own, own), len(part))
            logit = bias + np.bincount(seg, w[at], len(part)) + 0.5 * ((total**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[part]) / len(part)
            pull, used = g[:, None] * total, np.bincount(at, minlength=len(known)) > 0
            slope = np.bincount(at, g[seg], len(known))
            gv = np.stack([np.bincount(at, pull[seg, f], len(known)) for f in range(FACTORS)], 1) - slope[:, None] * v
            gw, gv, gb = slope + decay * w * used, gv + decay * v * used[:, None], g.sum()
            sum_b, sum_w, sum_v = sum_b + gb**2, sum_w + gw**2, sum_v + gv**2
            bias -= rate * gb / np.sqrt(sum_b)
            w -= rate * gw / np.sqrt(sum_w)
            v -= rate * gv / np.sqrt(sum_v)
    return Machine(place, bias, w, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 1_000):
            part = b.slice(k, 1_000)
            found = pa.array([terms(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), found], names=["doc_id", "y", "terms"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Fit on about ``sample`` labelled rows that aren't held out, chosen by a hash of their ids."""
    ship(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = sample / max(marks.count(), 1)
    chosen = marks.where(draw("doc_id", seed=7) <= share)
    # the sample's ids are few: ``sample`` in expectation, whatever the tables' sizes
    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(_term_rows, "doc_id long, y double, terms array<int>")
    rows = found.groupBy("doc_id", "y").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms")).toArrow()
    if not rows.num_rows:
        return None
    lists = rows["terms"].combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.argsort(rows["doc_id"].to_numpy())
    return fit([values[ends[i] : ends[i + 1]] for i in order], rows["y"].to_numpy()[order])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    d = columns_or_null(docs, doc_id="long", text="string")
    machine = d.sparkSession.sparkContext.broadcast(train(d, labels, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for b in batches:
            for k in range(0, b.num_rows, 1_000):
                part = b.slice(k, 1_000)
                s = [m.score(terms(t)) if m else 0.0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = d.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The query: every document's toxicity."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
