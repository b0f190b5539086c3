"""Quality classifier: kernel ridge on random Fourier features (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.llm.common import (
    ALNUM, BLOCK_BYTES, NONSPACE, cut, documents, hashed_words, small_batches, table, text_blocks, unused, with_text,
)

#: Random features; their scale (a kernel width in standard deviations); ridge.
FEATURES, WIDTH, RIDGE, SEED = 192, 2.0, 1e-3, 11
#: Bins of the raw score for the calibration, and of which folds it learns.
BINS, LOW, HIGH = 512, -0.5, 1.5
FOLDS, HELD_OUT, CALIBRATES = 4, 2, 3
#: Partial sums meet in so many groups before they reach the driver.
SUM_GROUPS = 8
KEEP_FROM = 0.7

#: Classes of bytes: other symbols, letters a-z, A-Z, digits, blanks, line ends, sentence marks, beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[[*b".,;:!?'\"-()"]] = 4, 5, 6
STATS = (
    "log_bytes", "symbol", "lower", "upper", "digit", "blank", "line_end", "mark", "wide", "word_length", "word_spread",
    "distinct", "top_word", "repeats", "bare", "log_line",
)


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text of a block; a long text is counted in pieces."""
    n = len(offsets) - 1
    if n == 1:
        parts = [np.bincount(_CLASS[data[a : a + BLOCK_BYTES]], minlength=8) for a in range(0, len(data), BLOCK_BYTES)]
        return np.sum(parts, axis=0).reshape(1, 8) if parts else np.zeros((1, 8), np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(row * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS for each text of a block; an empty text has zeros."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATS)))
    share = byte_classes(data, offsets)
    lines = share[:, 5] + 1
    out[:, 0] = np.log1p(sizes)
    out[:, 1:9] = share / np.maximum(sizes, 1)[:, None]
    hashes, lengths, last, first = hashed_words(data, offsets, NONSPACE)
    counts = np.diff(first)
    some = np.maximum(counts, 1)
    length = lengths.astype(float)
    sums = lambda v: np.diff(np.append(0, np.cumsum(v))[first])
    out[:, 9] = sums(length) / some
    out[:, 10] = np.sqrt(np.maximum(sums(length * length) / some - out[:, 9] ** 2, 0))
    word_row = np.repeat(np.arange(n), counts)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    out[:, 13] = sums(same) / some
    order = np.lexsort((hashes, word_row)) if n > 1 else np.argsort(hashes)
    h, r = hashes[order], word_row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    top = np.zeros(n)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(h))))
    out[:, 11] = np.bincount(r[at], minlength=n) / np.sqrt(some)
    out[:, 12] = top / some
    out[:, 14] = sums((~ALNUM[last]).astype(float)) / some
    out[:, 15] = np.log1p(sizes / lines)
    return out


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array of float) of each text, in one pass over the whole texts.

    Null text: empty, which has zeros. Repeated rows and null doc_ids: a row each.
    Other columns are left out. No rows: no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                values = text_stats(data, offsets).astype(np.float32)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, values.size + 1, len(STATS), dtype=np.int32), pa.array(values.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), lists], ["doc_id", "stats"]
                )

    return with_text(docs, "doc_id").mapInArrow(work, "doc_id long, stats array<float>")


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(SEED)
        w = random.standard_normal((x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]) / 2)
        shift = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + shift)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the raw score so that order within a step is kept."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.curve) + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1), 0, 1)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing means closest to sums / counts."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts, strict=True):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([s / c for s, c, _ in blocks], [int(k) for *_, k in blocks])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(STATS))


def fit(stats_of: DataFrame, labels: DataFrame) -> Model:
    """The model from labelled rows outside the held-out fold.

    Normal equations are summed within each partition, then in SUM_GROUPS groups;
    the driver gets those sums (fixed size) and solves them. The calibration fold
    gives counts in BINS bins. Labels that are null or of no document are left
    out; several labels of one document all count. Without labels, or with one
    class only, every score is that class's rate (0.5 without labels).
    """
    marks = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    marked = stats_of.join(marks, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    rows = cut(marked.select("fold", "y", "stats"))
    names = range(len(STATS))
    moment = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("rate"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in names],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in names],
    ).first()
    zeros = np.zeros(FEATURES + 1)
    if not moment.n or moment.rate in (0.0, 1.0):
        rate = 0.5 if not moment.n else moment.rate
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), zeros, (np.array([0.0, 1.0]), np.array([rate, rate])))
    mean = np.array([moment[f"m{i}"] for i in names])
    scale = np.maximum(np.array([moment[f"s{i}"] for i in names]), 1e-6)
    plain = Model(mean, scale, zeros, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    groups = SUM_GROUPS

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                z = plain.features(_column(piece, "stats"))
                both = np.hstack([z, piece.column("y").to_numpy()[:, None]])
                total = both.T @ both if total is None else total + both.T @ both
                part += piece.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"]
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [total.tobytes()]})

    schema = "part int, sums binary"
    sums = rows.where(F.col("fold") != CALIBRATES).select("y", "stats").mapInArrow(equations, schema)
    parts = sums.groupBy("part").applyInPandas(add, schema).collect()
    weights = zeros
    if parts:
        whole = sum(np.frombuffer(r.sums) for r in parts).reshape(FEATURES + 2, FEATURES + 2)
        a, b = whole[:-1, :-1], whole[:-1, -1]
        weights = np.linalg.solve(a + RIDGE * moment.n / FEATURES * np.eye(len(a)), b)
    ridge = Model(mean, scale, weights, plain.curve)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = ridge.raw(_column(batch, "stats"))
            bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], ["bin", "y"])

    bins = (
        rows.where(F.col("fold") == CALIBRATES)
        .select("y", "stats")
        .mapInArrow(binned, "bin int, y double")
        .groupBy("bin")
        .agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    if not bins:
        return ridge
    bins.sort(key=lambda r: r.bin)
    places = LOW + (np.array([r.bin for r in bins]) + 0.5) * (HIGH - LOW) / BINS
    means = isotonic(np.array([r.y for r in bins]), np.array([r.n for r in bins], float))
    return Model(mean, scale, weights, (places, means))


def scored(stats_of: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) from ``stats``, a row each, ties and null doc_ids as they come.

    A null doc_id is not held out. No rows: no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(_column(batch, "stats")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], ["doc_id", "score"])

    rows = stats_of.select("doc_id", "stats").mapInArrow(work, "doc_id long, score double")
    return rows.select(
        "doc_id",
        (F.coalesce(fold(F.col("doc_id")), F.lit(0)) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


def with_stats(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the stats of each text in a column ``name``; the other columns stay in the JVM."""

    @F.arrow_udf("array<float>")
    def stats_of(texts: pa.Array) -> pa.Array:
        values = [text_stats(data, offsets).astype(np.float32).ravel() for *_, data, offsets in text_blocks(texts)]
        flat = np.concatenate(values) if values else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(STATS), dtype=np.int32), pa.array(flat))

    small_batches(docs.sparkSession)
    return docs.withColumn(name, stats_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def score_of(model: Model, name: str) -> Column:
    """The score from a column of stats."""

    @F.arrow_udf("double")
    def score(lists: pa.Array) -> pa.Array:
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(STATS))
        return pa.array(model.score(x), pa.float64())

    return score(F.col(name))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier, fitted on their labelled rows, rejects.

    Texts are gone over twice, for the fit and for the scores, and written nowhere: a
    file of them would lie on disk until the last stage. Null and empty texts are scored like others;
    equal rows and rows of a null doc_id are scored each; a text of any length is
    counted in pieces; further columns stay as they are, whatever their names; no
    rows give no rows.
    """
    name = unused(docs, "stats")
    model = fit(stats(docs), labels)
    return with_stats(docs, name).where(score_of(model, name) >= KEEP_FROM).drop(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6: a score for every document, empty texts too."""
    of = cut(stats(documents(spark, sf_dir)))
    return scored(of, fit(of, table(spark, sf_dir, "labels")))
