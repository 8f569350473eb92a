"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct tokens (lower case) and their first 4 and 6 bytes,
hashed to ``BUCKETS``. Two kinds of buckets are kept: up to ``SELECTED`` that tell the
classes apart best by themselves, and up to ``PAIRED`` that do so in pairs, whatever each
does alone: a machine of the former leaves errors of one sign on the texts with both, by
more than chance over all pairs of the ``CANDIDATES`` most common buckets. So an insult
with a group mention counts even where either word alone is as common in clean texts.
The machine's score is

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so that pairs of terms count beyond their single weights. It is trained on the driver
from at most ``MAX_TRAINING`` labelled rows, chosen by a hash of the id alike at every
size of the corpus, and scores whole texts in Arrow batches.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import require, with_text_columns
from tidemark.llm.text import NOT_ALNUM, Words, buffers, lower, prefix_hash, span_hash

BUCKETS = 1 << 18
SELECTED = 4096
FACTORS = 8
#: Labelled rows that the model is fitted to: half of them of each class at most.
MAX_TRAINING = 12_000
PREFIXES = (4, 6)
#: Least z-value of a bucket's own difference between the classes, to leave chance out.
LEAST_Z = 3.0
#: Buckets whose pairs are looked at, those kept for their pairs, and the chance of a false pair.
CANDIDATES = 4096
PAIRED = 1024
FALSE_PAIR = 0.01


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all distinct terms, ordered by text."""
    data, offsets = buffers(column)
    data = lower(data)
    words, prefix = Words(data, offsets, NOT_ALNUM), prefix_hash(data)
    rows, hashes = [words.doc], [words.hashes(prefix)]
    for n in PREFIXES:
        long = words.end - words.start > n
        rows.append(words.doc[long])
        hashes.append(span_hash(prefix, words.start[long], words.start[long] + n) + np.uint64(n))
    key = np.concatenate(rows) * BUCKETS + (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) % BUCKETS
    key = np.unique(key)
    return key // BUCKETS, key % BUCKETS


class Machine:
    """A trained model: the place of each selected bucket (or -1), weights, factors, bias."""

    def __init__(self, place: np.ndarray, w: np.ndarray, v: np.ndarray, b: float):
        self.place, self.w, self.v, self.b = place, w, v, b

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.chances(*terms(column), len(column))

    def chances(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        at = self.place[bucket]
        row, at = row[at >= 0], at[at >= 0]
        z = self.b + raw_scores(row, at, n, self.w, self.v)[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def raw_scores(row: np.ndarray, at: np.ndarray, n: int, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores without the bias, and each text's sums of factors."""
    z = np.bincount(row, w[at], n).astype(float)
    sums = np.zeros((n, v.shape[1]))
    for f in range(v.shape[1]):
        x = v[at, f]
        sums[:, f] = np.bincount(row, x, n)
        z += 0.5 * (sums[:, f] ** 2 - np.bincount(row, x * x, n))
    return z, sums


def select_singles(row: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The buckets whose share of texts differs most between the classes, by z-value; ties by number."""
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    c1 = np.bincount(bucket[label[row] == 1], minlength=BUCKETS)
    c0 = np.bincount(bucket[label[row] == 0], minlength=BUCKETS)
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[(c1 + c0 < 3) | (z < LEAST_Z)] = 0
    best = np.argsort(-z, kind="stable")[:SELECTED]
    return best[z[best] > 0]


def select_paired(row: np.ndarray, bucket: np.ndarray, error: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """The buckets of the pairs on whose texts the errors add up furthest beyond chance."""
    n = len(error)
    count = np.bincount(bucket, minlength=BUCKETS)
    chosen = np.sort(np.argsort(-count, kind="stable")[:CANDIDATES])
    chosen = chosen[(count[chosen] >= 10) & (count[chosen] < n)]
    if len(chosen) < 2:
        return chosen[:0]
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[bucket]
    row, at = row[at >= 0], at[at >= 0]
    total, spread = (np.zeros((len(chosen), len(chosen)), np.float32) for _ in range(2))
    for i in range(0, n, 1024):
        a, b = np.searchsorted(row, [i, i + 1024])
        matrix = np.zeros((min(1024, n - i), len(chosen)), np.float32)
        matrix[row[a:b] - i, at[a:b]] = 1
        total += matrix.T @ (matrix * error[i : i + 1024, None].astype(np.float32))
        spread += matrix.T @ (matrix * variance[i : i + 1024, None].astype(np.float32))
    z = np.abs(total) / np.sqrt(spread + 1)
    np.fill_diagonal(z, 0)
    best = z.max(1)
    least = NormalDist().inv_cdf(1 - FALSE_PAIR / len(chosen) ** 2)
    order = np.argsort(-best, kind="stable")[:PAIRED]
    return chosen[order[best[order] > least]]


def train(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, shift: float = 0.0) -> Machine:
    """Select buckets and fit a machine of them; rows must be ordered by text.

    shift is added to the bias afterwards: the log of how much more often one class
    was sampled, so that scores are probabilities at the corpus's own rate.
    """
    singles = select_singles(row, bucket, label)
    machine = fit_machine(row, bucket, label, singles)
    p = machine.chances(row, bucket, len(label))
    chosen = np.union1d(singles, select_paired(row, bucket, label - p, p * (1 - p)))
    if len(chosen) > len(singles):
        machine = fit_machine(row, bucket, label, chosen)
    machine.b += shift
    return machine


def fit_machine(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, chosen: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, batch: int = 256, seed: int = 5) -> Machine:
    """A machine of the chosen buckets, by Adagrad on the logistic loss."""
    place = np.full(BUCKETS, -1, np.int32)
    chosen = np.sort(chosen)
    place[chosen] = np.arange(len(chosen))
    at = place[bucket]
    row, at = row[at >= 0], at[at >= 0]
    n, rng = len(label), np.random.Generator(np.random.PCG64(seed))
    bounds = np.searchsorted(row, np.arange(n + 1))
    w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), FACTORS)), 0.0
    gw, gv, gb = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs if len(chosen) and 0 < label.sum() < n else 0):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            part = order[i : i + batch]
            size = bounds[part + 1] - bounds[part]
            flat = np.repeat(bounds[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r, a = np.repeat(np.arange(len(part)), size), at[flat]
            z, sums = raw_scores(r, a, len(part), w, v)
            d = (1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - label[part]) / len(part)
            b_step = d.sum()
            gb += b_step**2
            b -= rate * b_step / np.sqrt(gb)
            used, inverse = np.unique(a, return_inverse=True)
            step = np.bincount(inverse, d[r], len(used)) + decay * w[used]
            gw[used] += step**2
            w[used] -= rate * step / np.sqrt(gw[used])
            for f in range(FACTORS):
                x = v[a, f]
                step = np.bincount(inverse, d[r] * (sums[r, f] - x), len(used)) + decay * v[used, f]
                gv[used, f] += step**2
                v[used, f] -= 0.2 * rate * step / np.sqrt(gv[used, f])
    return Machine(place, w, v, b)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Machine:
    """Train on labelled rows that are not held out, at most MAX_TRAINING.

    Several labels of one id count as 1 if any is; nulls are left out. Without both
    classes the machine scores every text 0.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(id_col))).groupBy(id_col).agg((F.max(label) >= 1).cast("int").alias("__label"))
    totals = dict(marks.groupBy("__label").count().collect())
    half = MAX_TRAINING // 2
    parts = [marks.where(F.col("__label") == y).orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), id_col).limit(half) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    chosen = documents.select(documents[id_col], documents[text].alias("__text")).join(F.broadcast(sample), id_col).select("__label", "__text")

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        row, bucket = terms(part.column(part.num_columns - 1))
        bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
        return {"terms": pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))}

    table = with_text_columns(chosen, "__text", run, [("terms", T.ArrayType(T.IntegerType()))], drop_text=True).orderBy("__label", F.xxhash64("terms")).toArrow()
    listed = table.column("terms").combine_chunks()
    y = table.column("__label").to_numpy().astype(np.int64)
    size = np.diff(listed.offsets.to_numpy()) if len(y) else np.zeros(0, np.int64)
    if not 0 < y.sum() < len(y):
        return Machine(np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)), -30.0)
    rates = {c: min(half, n) / n for c, n in totals.items()}
    return train(np.repeat(np.arange(len(y)), size), listed.values.to_numpy().astype(np.int64), y, float(np.log(rates[0] / rates[1])))


def toxicity(documents: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, drop_text: bool = False) -> DataFrame:
    """documents (all columns and rows, or those in keep) with ``score`` from 0 to 1.

    Null and empty texts and texts without a known term have the score of the bias.
    An input column named score is replaced; an empty table gives an empty result.
    """
    require(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"score": pa.array(shared.value.scores(part.column(part.num_columns - 1)))}

    return with_text_columns(documents, text, run, [("score", T.DoubleType())], keep, drop_text)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(documents, fit(documents, labels), drop_text=True)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
