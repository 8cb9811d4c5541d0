"""Words of whole Arrow string columns and hashes of runs of words, as numpy arrays.

Texts are handled as UTF-8 bytes: the separators are ASCII, so words cut at the byte
level are the words of the text. Hashes have fixed seeds, so every executor computes the
same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

U64 = np.uint64
#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 19
BATCH_ROWS = 1000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII white space, control characters and punctuation.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends texts to Python in batches of at most ``BATCH_ROWS`` rows from now on, as whole batches are
    held by the JVM and by Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def input_bytes(df: DataFrame) -> int:
    """The bytes of the tables that df reads, as Spark knows them; sources of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words of some texts: byte positions ``start`` and ``end``; document d has words first[d]:first[d + 1]."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, sep: np.ndarray = SPACE):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        inside = ~sep[self.data]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        head[cut] = inside[cut]
        tail[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._coded: tuple[np.ndarray, list[bytes]] | None = None

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """The XXH64 of each word's bytes; each distinct word is hashed once."""
        if self._coded is None:
            size = self.end - self.start
            edges = np.concatenate([[0], np.cumsum(size)])
            inside = np.zeros(len(self.data) + 1, np.int8)
            inside[self.start] += 1
            inside[self.end] -= 1
            close = self.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
            coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(close))]).dictionary_encode()
            self._coded = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        which, distinct = self._coded
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in distinct], U64)[which]


def grams(word_hashes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of words i:i + k for every i of ``at``, or for all i; the caller leaves out those that cross documents.

    The words' hashes are scrambled in one after the other, so no structure of the words cancels out.
    """
    n = max(0, len(word_hashes) - k + 1) if at is None else len(at)
    out = np.full(n, 0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF, U64)
    for j in range(k):
        out = mix(out ^ (word_hashes[j : j + n] if at is None else word_hashes[at + j]))
    return out


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``limit`` bytes of text each, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an array: planes of zeros then cost nothing after compression."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(raw: bytes, dtype, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, n).T).reshape(-1).view(dtype)
