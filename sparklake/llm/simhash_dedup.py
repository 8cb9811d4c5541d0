"""SimHash near-duplicates by a binary trie self-join.

The distinct 64-bit fingerprints form a binary trie. The self-join walks pairs of trie nodes together,
adds up the differing bits on the way down and prunes a pair as soon as they exceed the budget. To
spread the walk over a cluster the trie is taken in four rotations of 16 bits: two fingerprints that
differ in at most 3 bits agree in one of four 16-bit blocks, so in one rotation they lie below the same
node at depth 16, and the walk starts from each such node paired with itself. Groups under one node that
hold more than ``GROUP`` fingerprints are split by their next bits into pairs of sub-nodes, which are
separate tasks; those that share these bits too are dealt over pairs of hashed blocks. Each task reduces its links to a spanning forest, so dense groups send no more rows
than they have members. Components come from alternating large-star and small-star rounds; links,
components and fingerprints stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklake.llm import shingle_dedup
from sparklake.llm._text import pieces, small_batches
from sparklake.llm._trie import BITS, components, roots, walk
from sparklake.session import materialise

BUDGET, BLOCK = 3, 16
#: Fingerprints below one node that a single task walks.
GROUP = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:z], seed) for a, z in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    total, step = np.zeros(BITS, np.int64), 1 << 14
    for at in range(0, len(hashes), step):
        total += np.unpackbits(hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, text_hash, fp): the fingerprint as a signed long; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = np.array([simhash(x, shingle) for x in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.record_batch([part.column("id"), part.column("text_hash"), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, fp long").withColumnRenamed("id", id_col)


def links(distinct: DataFrame, group: int = GROUP, budget: int = BUDGET) -> DataFrame:
    """(u, v), u < v: edges whose components are those of all pairs of fingerprints ``fp`` within the budget.

    Within each task the links are reduced to a spanning forest; no link between different components is lost.
    """
    rotated = distinct.select("fp", F.explode(F.array(*[F.lit(r) for r in range(BITS // BLOCK)])).alias("r")).select(
        "fp", "r", F.expr("shiftleft(fp, r * 16) | CASE WHEN r = 0 THEN 0L ELSE shiftrightunsigned(fp, 64 - r * 16) END").alias("x")
    )
    rotated = rotated.withColumn("node", F.expr(f"shiftrightunsigned(x, {BITS - BLOCK})"))
    # at most 4 * 2**16 rows, whatever the input
    large = rotated.groupBy("r", "node").count().where(F.col("count") > group).select("r", "node", F.least(F.lit(12), F.ceil(F.log2(F.col("count") / group)) + 1).cast("int").alias("extra"))
    tasks = rotated.join(F.broadcast(large), ["r", "node"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    # a split group's member goes to the task of each pair of sub-nodes that holds its own sub-node
    own = F.expr(f"CASE WHEN extra = 0 THEN 0L ELSE shiftrightunsigned(shiftleft(x, {BLOCK}), 64 - extra) END")
    tasks = tasks.withColumn("sub", own).withColumn("other", F.explode(F.expr("filter(sequence(0L, shiftleft(1L, extra) - 1), o -> bit_count(o ^ sub) <= 3)")))
    tasks = tasks.select("r", "node", "extra", F.least("sub", "other").alias("s1"), F.greatest("sub", "other").alias("s2"), "x", "fp")
    # sub-nodes may be as dense as their node: what is still too much for a task meets in the pairs of its blocks
    keys = ["r", "node", "s1", "s2"]
    dense = tasks.groupBy(*keys).count().where(F.col("count") > 4 * group).select(*keys, F.ceil(F.col("count") / group).cast("int").alias("m"))
    tasks = tasks.join(dense, keys, "left").withColumn("b", F.pmod(F.xxhash64("fp"), F.coalesce("m", F.lit(1))).cast("int"))
    blocks = "CASE WHEN m IS NULL THEN array(struct(0 AS i, 0 AS j)) ELSE transform(filter(sequence(0, m - 1), j -> j <> b), j -> struct(least(b, j) AS i, greatest(b, j) AS j)) END"
    tasks = tasks.withColumn("t", F.explode(F.expr(blocks))).select(*keys, "t.*", "extra", "x", "fp")
    keys = [*keys, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def join(table: pa.Table) -> pa.RecordBatch:
            cols = {n: table.column(n).to_numpy() for n in table.column_names}
            x, fp = cols["x"].astype(np.int64).view(np.uint64), cols["fp"].astype(np.int64)
            order = np.lexsort((x, *(cols[k] for k in reversed(keys))))
            x, fp = x[order], fp[order]
            own = [cols[k][order] for k in keys]
            new = np.ones(len(x), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in own], axis=0)
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(x))
            # both sub-nodes of a split pair: members of s1 come first, as x is sorted
            extra, s1, s2 = cols["extra"][order][lo].astype(np.int64), own[2][lo], own[3][lo]
            sub = (x << np.uint64(BLOCK)) >> (np.uint64(64) - np.maximum(np.repeat(extra, hi - lo), 1).astype(np.uint64))
            in_first = np.concatenate([[0], np.cumsum((np.repeat(extra, hi - lo) == 0) | (sub.astype(np.int64) == np.repeat(s1, hi - lo)))])
            mid = lo + in_first[hi] - in_first[lo]
            cross = s1 != s2
            mid = np.where(cross, mid, hi)
            label = np.arange(len(x))
            for e in np.unique(extra):
                at = extra == e
                pairs = (lo[at], mid[at], np.where(cross, mid, lo)[at], hi[at], np.bitwise_count(s1[at] ^ s2[at]).astype(np.int64))
                live = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3])
                for i, j in walk(x, tuple(v[live] for v in pairs), BLOCK + int(e), budget):
                    label = roots(label, i, j)
            tied = np.flatnonzero(label != np.arange(len(x)))
            u, v = fp[tied], fp[label[tied]]
            return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        last = None
        for batch in batches:
            # rows come sorted by task; cut where one ends, once enough rows are held
            held.append(batch)
            rows += len(batch)
            if rows >= 2 * group:
                table = pa.Table.from_batches(held)
                key = np.stack([table.column(n).to_numpy() for n in keys])
                change = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0))
                if len(change):
                    cut = int(change[-1]) + 1
                    yield join(table.slice(0, cut))
                    held, rows = table.slice(cut).to_batches(), len(table) - cut
            last = batch
        if last is not None and rows:
            yield join(pa.Table.from_batches(held))

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tasks.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")
    return found.where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET, threshold: float | None = None) -> DataFrame:
    """Per row: id_col, text_hash, fp (the fingerprint as a signed long), component_id: the smallest id reachable over links; and first.

    Fingerprints link at ``budget`` differing bits or fewer, at most 3. With a ``threshold`` (and any budget) a link needs that Jaccard
    similarity of the sets of shingles too, computed exactly, and fingerprints are those of the sets; see ``shingle_dedup``.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; shingles of ``shingle`` words,
    a shorter text being one shingle. Null and empty texts have fingerprint 0; without a threshold they are linked like any other,
    with one they are copies of each other and of nothing else. Texts are read whole, whatever their length. Null ids stay null, are never a component's id unless it has no
    other, and come last in the order; repeated rows are kept. text_hash is Spark's xxhash64 of the text, and first is true for the rows of the
    component's first id and text hash: one row, if no row repeats. Other columns are left out, so none can clash. An empty table gives no rows.
    """
    if threshold is not None:
        found = shingle_dedup.clusters(docs, id_col, text_col, shingle, threshold, budget)
        rows = found.select(F.nullif(F.col("id"), F.lit(-(1 << 63))).alias("id"), "h", F.col("sim").alias("fp"), F.col("key"), F.col("root"))
    else:
        if budget > BUDGET:
            raise ValueError(f"a budget over {BUDGET} bits needs a threshold")
        found = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        prints = found.select(F.col(id_col).alias("id"), F.col("text_hash").alias("h"), "fp", F.col("fp").alias("key"))
        rows = prints.join(components(links(prints.select("fp").distinct(), budget=budget)), F.col("key") == F.col("node"), "left")
        rows = rows.select("id", "h", "fp", "key", F.coalesce("root", "key").alias("root"))
    # the sets first: most components are one, and their many rows combine before the exchange by root
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    of_key = rows.groupBy("key", "root").agg(F.min(place).alias("place"))
    of_root = of_key.groupBy("root").agg(F.min("place").alias("place"))
    of_key = of_key.select("key", "root").join(of_root, "root").select("key", F.col("place.id").alias("component_id"), F.col("place.h").alias("first_h"))
    out = rows.drop("root").join(of_key, "key")
    first = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first_h"))
    return out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "fp", "component_id", first.alias("first"))
