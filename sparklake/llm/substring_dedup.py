"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words. Anchors are shorter runs of words, hashed only where the
word position modulo ``PERIOD`` lies in the difference cover ``COVER``: for any two positions i and j
some shift d < PERIOD makes both i + d and j + d covered. With PERIOD - 1 + anchor <= window, two equal
windows therefore hold a common anchor at the same offset, whatever their alignment. So:

1. hash the anchors (4 of 13 positions) and find those that occur more than once;
2. extend: only windows around a repeated anchor are hashed, with 128 bits, and each hash's first
   occurrence (smallest doc_id, then start) is found; every later window is flagged;
3. words covered by a flagged window are removed.

Both exchanges send packed arrays, at most one entry per hash and batch of documents: what repeats
inside a batch is settled there, so a passage that a third of all documents share sends one entry per
batch to its bucket. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklake.llm._text import Words, grams, input_bytes, pack, pieces, small_batches, unpack
from sparklake.session import materialise

WINDOW = 20
PERIOD = 13
#: Every difference modulo 13 occurs between two of these.
COVER = (0, 1, 3, 9)
#: Entries held by a task before it settles and sends them.
FLUSH = 1 << 19
#: Settled entries sent along with one bucket.
KNOWN = 1 << 13
#: Stands for a null doc_id in the key of a row.
NO_ID = -(1 << 63)
#: Seeds of the two independent 64-bit hashes of a window.
_A, _B = 11, 12
#: Bytes of input whose entries one bucket settles.
BUCKET_BYTES = 4 << 20


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (id, text, ...) with k: a document's key, in the order of ids, null ids first.

    The id is the key as long as no id (null is one here) has two texts; else each distinct (id, text) has a key of its own,
    its place in a sorted table of ids and text hashes.
    """
    own, texts = F.coalesce("id", F.lit(NO_ID)), F.xxhash64("text")
    several = rows.groupBy(own.alias("k")).agg(F.min(texts).alias("lo"), F.max(texts).alias("hi")).where("lo <> hi")
    if several.isEmpty():
        return rows.withColumn("k", own)
    keys = rows.select(F.col("id").alias("_id"), texts.alias("_h")).distinct().sort(F.col("_id").asc_nulls_first(), "_h")
    keys = materialise(keys.withColumn("k", F.monotonically_increasing_id()), "keys")
    return rows.withColumn("_own", texts).join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_h"))).drop("_id", "_h", "_own")


def _send(bucket_of: np.ndarray, keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, buckets: int, known: tuple[np.ndarray, np.ndarray], turn: int) -> pa.RecordBatch:
    """Rows (bucket, payload): entries sorted by bucket; ``known`` (doc, pos) ride along in turn with the buckets."""
    edges = np.searchsorted(bucket_of, np.arange(buckets + 1))
    rows, out = [], []
    for b in np.flatnonzero(np.diff(edges)):
        a, z = edges[b], edges[b + 1]
        ids, index = np.unique(doc[a:z], return_inverse=True)
        head = np.array([z - a, len(ids), 0], np.int64).tobytes()
        first = np.diff(keys[0][a:z], prepend=np.uint64(0))
        out.append(head + pack(first) + b"".join(pack(k[a:z]) for k in keys[1:]) + pack(index.astype(np.uint32)) + pack(pos[a:z].astype(np.int32)) + pack(ids))
        rows.append(int(b))
    for k, at in enumerate(range(0, len(known[0]), KNOWN)):
        ids, index = np.unique(known[0][at : at + KNOWN], return_inverse=True)
        out.append(np.array([0, len(ids), len(index)], np.int64).tobytes() + pack(index.astype(np.uint32)) + pack(known[1][at : at + KNOWN].astype(np.int32)) + pack(ids))
        rows.append((turn + k) % buckets)
    return pa.record_batch([pa.array(rows, pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])


def _receive(payloads: list[bytes], n_keys: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(n_keys)]
    doc, pos, known_doc, known_pos = ([np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)])
    for raw in payloads:
        n, m, k = np.frombuffer(raw, np.int64, 3)
        at, total = 24, int(n or k)

        def take(dtype, count, raw=raw):
            nonlocal at
            size = np.dtype(dtype).itemsize * int(count)
            at += size
            return unpack(raw[at - size : at], dtype, int(count))

        if n:
            keys[0].append(np.cumsum(take(np.uint64, n)))
            for j in range(1, n_keys):
                keys[j].append(take(np.uint64, n))
        index, where = take(np.uint32, total), take(np.int32, total)
        ids = take(np.int64, m)
        (doc if n else known_doc).append(ids[index])
        (pos if n else known_pos).append(where)
    return [np.concatenate(k) for k in keys], *(np.concatenate(x) for x in (doc, pos, known_doc, known_pos))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the index of each run's head, for every entry; and the runs' lengths, for every entry."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    size = np.diff(heads, append=len(new))
    return np.repeat(heads, size), np.repeat(size, size)


def _pairs(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(pos, pa.int32())], ["k", "pos"])


def repeated_anchors(docs: DataFrame, window: int, buckets: int, most: int = FLUSH) -> DataFrame:
    """(k, pos): each covered position whose anchor occurs at another covered position too."""
    size = window - PERIOD + 1
    covered = np.isin(np.arange(PERIOD), COVER)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turn = 7919 * TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            head, count = _runs(h)
            one = head == np.arange(len(h))
            many = count > 1
            # a run's entry without place: the batch knows already that all its places repeat
            place = np.where(many, -1, pos)
            bucket_of = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            return _send(bucket_of[one], [h[one]], doc[one], place[one], buckets, (doc[many], pos[many]), turn)

        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                counts, first = words.counts(), words.first
                doc_of = words.doc_of()
                at = np.arange(len(words)) - first[doc_of]
                use = np.flatnonzero(covered[at % PERIOD] & (at + size <= counts[doc_of]) & (counts[doc_of] >= window))
                if len(use):
                    h = grams(words.hashes(_A), size, use) >> np.uint64(8) << np.uint64(8)
                    held.append((h, _ids(part.column("k"))[doc_of[use]], at[use].astype(np.int32)))
                if sum(len(x[0]) for x in held) >= most:
                    yield flush()
                    turn += 104729
        if held:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        (h,), doc, pos, known_doc, known_pos = _receive(table.column("payload").to_pylist(), 1)
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        _, count = _runs(h) if len(h) else (None, np.zeros(0, np.int64))
        keep = (count > 1) & (pos >= 0)
        return pa.Table.from_batches([_pairs(np.concatenate([doc[keep], known_doc]), np.concatenate([pos[keep], known_pos]))])

    sent = docs.mapInArrow(send, "bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(settle, "k long, pos int")


def later_windows(docs: DataFrame, anchors: DataFrame, window: int, buckets: int, most: int = FLUSH) -> DataFrame:
    """(k, pos): each window start whose words also start earlier. All columns of docs are read, as in the last step, which shares their exchange."""
    reach = PERIOD - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turn = 7919 * TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            h, g, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((pos, doc, g, h))
            h, g, doc, pos = h[order], g[order], doc[order], pos[order]
            head, _ = _runs(h, g)
            one = head == np.arange(len(h))
            late = (doc != doc[head]) | (pos != pos[head])
            bucket_of = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            return _send(bucket_of[one], [h[one], g[one]], doc[one], pos[one], buckets, (doc[late], pos[late]), turn)

        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                first, n = words.first, len(words)
                if n >= window:
                    lists = part.column("at")
                    which = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                    place = first[which] + lists.flatten().to_numpy(zero_copy_only=False)
                    ok = place < first[which + 1]
                    which, place = which[ok], place[ok]
                    mark = np.zeros(n + 1, np.int32)
                    np.add.at(mark, np.maximum(place - reach, first[which]), 1)
                    np.add.at(mark, place + 1, -1)
                    doc_of = words.doc_of()
                    use = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (np.arange(n) + window <= first[doc_of + 1]))
                    if len(use):
                        h, g = (grams(words.hashes(seed), window, use) for seed in (_A, _B))
                        held.append((h, g, _ids(part.column("k"))[doc_of[use]], (use - first[doc_of[use]]).astype(np.int32)))
                if sum(len(x[0]) for x in held) >= most:
                    yield flush()
                    turn += 104729
        if held:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        (h, g), doc, pos, known_doc, known_pos = _receive(table.column("payload").to_pylist(), 2)
        order = np.lexsort((pos, doc, g, h))
        h, g, doc, pos = h[order], g[order], doc[order], pos[order]
        late = np.zeros(0, bool)
        if len(h):
            head, _ = _runs(h, g)
            late = (doc != doc[head]) | (pos != pos[head])
        return pa.Table.from_batches([_pairs(np.concatenate([doc[late], known_doc]), np.concatenate([pos[late], known_pos]))])

    found = docs.join(anchors.groupBy("k").agg(F.collect_set("pos").alias("at")), "k")
    sent = found.mapInArrow(send, "bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(settle, "k long, pos int")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None, keep: tuple[str, ...] = (), normalise: bool = True, flush: int = FLUSH) -> DataFrame:
    """Per row of ``docs``: id_col, the ``keep`` columns, n_words, n_removed, kept (the kept words joined by one space; null for a null text).

    Without ``normalise`` a text of which nothing goes stays exactly as it is.

    Words are runs of characters other than space and U+0009 to U+000D. A word goes if a window over it
    also starts earlier: in a smaller id, or in the same document before. Windows are judged on the input.
    Null and empty texts have no words. Null ids come first in the order. Rows that share an id (or have none) and differ in their
    texts are documents of their own, in the order of a hash of the text; rows equal in both count as one document: each
    gets its results, and they don't flag each other. Texts may have any length. Columns not in ``keep`` are left out, and those in it may
    have any name but id_col, n_words, n_removed and kept (ValueError). An empty table gives no rows.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be at least {PERIOD + 1} words")
    spark = docs.sparkSession
    buckets = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)
    if {c.lower() for c in keep} & {id_col.lower(), "n_words", "n_removed", "kept"}:
        raise ValueError("keep clashes with the columns of the result")
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    docs = _keyed(docs)
    anchors = repeated_anchors(docs.select("k", "text"), window, buckets, flush)
    late = later_windows(docs, anchors, window, buckets, flush).groupBy("k").agg(F.collect_set("pos").alias("late"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for text, starts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("late"), strict=True):
                    words = (text or b"").split()
                    n = len(words)
                    if starts.is_valid:
                        mark = np.zeros(n + window + 1, np.int32)
                        at = starts.values.to_numpy(zero_copy_only=False)
                        at = np.unique(at[at + window <= n])
                        mark[at] += 1
                        mark[at + window] -= 1
                        words = list(compress(words, (np.cumsum(mark[:n]) == 0).tolist()))
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    kept.append(text if text is None or (not normalise and len(words) == n) else b" ".join(words))
                ids = part.column("id")
                rest = [part.column(f"_{i}") for i in range(len(keep))]
                yield pa.record_batch([ids, *rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", *(f"_{i}" for i in range(len(keep))), "n_words", "n_removed", "kept"])

    # the texts' exchange by k is the same as in later_windows, so Spark runs it once
    joined = docs.join(late, "k", "left")
    kinds = dict(docs.dtypes)
    schema = ", ".join(["id long", *(f"_{i} {kinds[f'_{i}']}" for i in range(len(keep))), "n_words long, n_removed long, kept string"])
    return joined.mapInArrow(finish, schema).withColumnsRenamed({"id": id_col} | {f"_{i}": c for i, c in enumerate(keep)})
