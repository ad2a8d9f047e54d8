"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and one-word skip-grams of the whole text. Training
takes at most `TRAIN_ROWS` labelled rows (those with the smallest hash of their id) and `TRAIN_BYTES` of their
texts in one task, which fits with per-coordinate rates and L1 sparsity; the weights that stay above zero are broadcast, at most
2 ** `FEATURE_BITS` of them.

Defined results: null and empty texts get the score of the bias alone; without a labelled row of each
class every score is 0; labels that are null are not used, and of several labels for one id the larger
counts; repeated and null ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, slices, small_batches, unused

FEATURE_BITS = 20
#: Bounds of the sample that a model is fitted on: labelled rows, by the hash of their id; bytes of their texts
#: in all, up to the row that would go beyond; and bytes of one text, longer ones being left out of the sample.
TRAIN_ROWS, TRAIN_BYTES, LONGEST = 16_000, 256 << 20, 4 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
#: How many times a toxic row counts: they are few, and a model that misses them is of no use. Chosen on a
#: fifth of the training rows (crc32 mod 5 is 1) by models of the others (2 to 4).
TOXIC_WEIGHT = 2.0
WORD = re.compile(r"[^\W_]+")
#: Words whose hashes a worker keeps; beyond it the memory is emptied.
CACHE_WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """The hashes as feature numbers."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def features(text: str, hashes: WordHashes) -> np.ndarray:
    """Feature numbers of the unigrams, bigrams and skip-grams of text, repeats included."""
    h = np.array(list(map(hashes.__getitem__, WORD.findall(text.lower()))), np.uint64)
    a, b, c = h * np.uint64(0x100000001B3), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
    return np.concatenate([mixed(h), mixed(a[:-1] ^ (h[1:] * b)), mixed(a[:-2] ^ (h[2:] * c))])


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, weights and bias fitted on binary features."""
    size = 1 << FEATURE_BITS
    z, n, bias, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            f = examples[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            g *= TOXIC_WEIGHT if labels[k] else 1.0
            sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA
            z[f] = zf + g - sigma * w
            n[f] = nf + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + bias_n**0.5)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return at, w[at], bias


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[int, float]:
    """Weights by feature number (-1: the bias) from the labelled rows of docs outside the held-out fifth."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(crc % 5 != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # What is chosen is decided without the texts; a repeated id must not widen the sample beyond its bounds.
    key, size = F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    light = docs.select("doc_id", key.alias("h"), size.alias("size")).where(F.col("size") <= LONGEST).join(F.broadcast(marked), "doc_id")
    light = light.groupBy("doc_id", "h").agg(F.first("size").alias("size"), F.first("toxic").alias("toxic")).withColumn("first", F.xxhash64("doc_id")).orderBy("first", "doc_id", "h").limit(rows)
    running = F.sum("size").over(Window.orderBy("first", "doc_id", "h"))
    light = light.withColumn("running", running).where(F.col("running") <= TRAIN_BYTES).select(F.col("doc_id").alias("i"), "h", "toxic")
    chosen = docs.select("doc_id", "text").join(F.broadcast(light), (F.col("doc_id") == F.col("i")) & (key == F.col("h")))
    chosen = chosen.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, examples, marks = WordHashes(), [], []
        for batch in (part for whole in batches for part in slices(whole)):
            examples += [np.unique(features(t or "", hashes)) for t in batch.column("text").to_pylist()]
            marks += batch.column("toxic").to_pylist()
        y = np.array(marks, float)
        if 0 < y.sum() < len(y):
            at, w, bias = ftrl(examples, y)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int64)), pa.array(np.r_[bias, w])], ["feature", "weight"])

    small_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id").alias("first"), "doc_id", "h"]
    rows = chosen.select(*order, F.col("toxic").cast("int").alias("toxic"), "text").repartition(1).sortWithinPartitions("first", "doc_id", "h").select("toxic", "text")
    return {r["feature"]: r["weight"] for r in rows.mapInArrow(fit, "feature long, weight double").collect()}


def scored(docs: DataFrame, model: dict[int, float], score: str, extra: list[str] | None = None) -> DataFrame:
    """The columns of extra (all of docs by default) and the score of every row, named as given."""
    columns = docs.columns if extra is None else extra
    shared = docs.sparkSession.sparkContext.broadcast((np.fromiter(model, np.int64, len(model)), np.fromiter(model.values(), float, len(model))))
    schema = docs.select(*columns).withColumn(score, F.lit(0.0)).schema
    state: dict = {}
    text_name = unused(docs, "scored_text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            at, w = shared.value
            table = np.zeros(1 << FEATURE_BITS)
            table[at[at >= 0]] = w[at >= 0]
            state.update(table=table, some=table != 0, bias=w[at < 0], hashes=WordHashes())
        out = []
        for text in batch.columns[-1].to_pylist():
            if not len(state["bias"]):
                out.append(0.0)
                continue
            f = features(text or "", state["hashes"])
            f = np.unique(f[state["some"][f]])
            out.append(1 / (1 + np.exp(-np.clip(state["bias"][0] + state["table"][f].sum(), -35, 35))))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*columns, score])

    return map_batches(docs.select(*columns, F.col("text").alias(text_name)), run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = scored(docs, train(docs, labels), "score", ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below one half."""
    score = unused(docs, "score")
    return scored(docs, train(docs, labels), score).where(F.col(score) < 0.5).drop(score)
