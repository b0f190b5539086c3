"""Helpers shared by the operators: checkpoints, Arrow text blocks, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.plans.joins import skew_join
from partgraph.plans.lineage import cut, discard, release, shared_folder

__all__ = ["cut", "release", "shared_folder", "skew_join"]

#: Texts are worked on in blocks of about this many bytes, so that the 8-byte
#: temporaries of numpy stay small whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def kept_while(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``written``, and deleted at the end: what is made of it must be cut or collected before."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}.parquet")
    yield df.sparkSession.read.parquet(f"{path}/{name}.parquet")
    discard(path, df.sparkSession)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, for columns that are dropped again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that go to a Python worker at once (Spark's default bounds rows, whatever their length)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def with_text(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """The named columns and ``text``, where a null text counts as empty, for Arrow batches of bounded bytes."""
    small_batches(docs.sparkSession)
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_digest() -> Column:
    """128 bits of SHA-256 of the text, null as empty: two texts of one digest are taken as equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def row_key() -> Column:
    """(doc_id, digest of the text): never null itself, equal for rows equal in both."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))


# --- blocks of UTF-8 bytes ---------------------------------------------------


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def text_blocks(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``block`` bytes: (first, end, bytes, offsets)."""
    data, offsets = utf8_column(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + block, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


# --- words and their hashes --------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True where a byte belongs to a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after
#: lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

#: True where a byte belongs to a word ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, bool)
NONSPACE[32] = False
NONSPACE[9:14] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the maximal runs of bytes of class ``inside``."""
    flag = inside[data]
    n = len(data)
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = flag[:-1]
    starts = np.flatnonzero(flag & (~before | breaks[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = flag[1:]
    ends = np.flatnonzero(flag & (~after | breaks[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one running sum over the block."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(0x1F)) * powers(_BASE, n), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(data: np.ndarray, inside: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of one text of about ``size`` bytes that end outside words; a longer word is not cut."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        while end < n:
            outside = np.flatnonzero(~inside[data[end : end + 4096]])
            if len(outside):
                end += int(outside[0])
                break
            end = min(end + 4096, n)
        yield at, end
        at = end


def hashed_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length, last byte) of each word and the first word of each row of a block of ``text_blocks``.

    A block of one long text is hashed in pieces, so that the temporaries of 8 and
    more bytes a byte are those of a piece and only some 17 bytes a word are kept.
    """
    if len(offsets) == 2 and len(data) > BLOCK_BYTES:
        parts = []
        for a, b in pieces(data, inside):
            h, n, last, _ = hashed_words(data[a:b], np.array([0, 0, b - a]), inside)
            parts.append((h, n, last))
        h, n, last = (np.concatenate(p) for p in zip(*parts, strict=True))
        return h, n, last, np.array([0, len(h)])
    starts, ends, first = word_spans(data, offsets, inside)
    return word_hashes(data, starts, ends), ends - starts, data[ends - 1] if len(ends) else data[:0], first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of ``width`` words; a shorter row has its whole sequence as one."""
    counts = np.diff(first)
    total = np.zeros(len(words), np.uint64)
    factors = powers(0xC2B2AE3D27D4EB4F, width + 1)[1:]
    for k in range(width):
        part = words * factors[k]
        total[: len(words) - k if k else None] += part[k:]
    # A start is whole where its row has width words from it.
    row = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][row] - np.arange(len(words))
    keep = left >= width
    rows, values = row[keep], mix(total[keep])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = []
        for r in short:
            w = words[first[r] : first[r + 1]]
            own.append((w * factors[: len(w)]).sum(dtype=np.uint64) + np.uint64(0xA5A5A5A5 + len(w)))
        rows = np.concatenate([rows, short])
        values = np.concatenate([values, mix(np.array(own, np.uint64))])
    return rows, values


def distinct_shingles(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row: (bounds of rows, hashes sorted within a row)."""
    hashes, _, _, first = hashed_words(data, offsets, inside)
    rows, values = shingle_hashes(hashes, first, width)
    if len(offsets) == 2:
        values = np.unique(values)
        return np.array([0, len(values)]), values
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[fresh], values[fresh]
    return np.searchsorted(rows, np.arange(len(offsets))), values
