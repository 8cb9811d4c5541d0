"""Near-duplicates by SimHash with exact verification, for budgets that 16-bit blocks can't serve.

Every text becomes the set of its shingles' hashes and two 64-bit SimHashes of that set. At 0.8 Jaccard similarity 64-bit
fingerprints differ in about ten bits, so the trie walk needs a budget of about two dozen and nodes to start from that similar texts
share whatever their bits. Those nodes are shingles: all sets are sorted in one order, what many texts hold last, and two sets of
similarity ``t`` have a common shingle among their first ``n - ceil(t * n) + 1``. Below each shared shingle the trie
self-join walks pairs of nodes and prunes beyond the budget; the second fingerprint then rules out chance.

1. The order comes from a Count-Min sketch over all texts: it decides how many pairs are walked, never the result.
2. Candidates only form families: neighbours below a shingle are joined first, then the walk joins what is still apart. Each
   task sends a spanning forest, so a dense group sends no more rows than it has members.
3. The sets of each family meet once, in one task or, for a large family, in tasks for pairs of blocks. There the same walk finds the
   candidates and their sets are compared exactly, nearest first, unless they are in one component already. Links leave as a spanning
   forest too; no pair leaves its task.

Sets, links, families and components stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklake.llm._text import Words, grams, input_bytes, mix, pack, pieces, small_batches, unpack
from sparklake.llm._trie import components, roots, walk
from sparklake.session import discard, materialise

#: Differing bits of the first fingerprint, and of both.
SHINGLE, THRESHOLD, BUDGET, BOTH = 5, 0.8, 26, 42
#: Counters of each of the sketch's two rows, and the pieces that they are summed in.
SLOTS, SLICES = 1 << 16, 64
#: Entries held by a task before it settles and sends them; bytes of input whose entries one bucket settles.
FLUSH, BUCKET_BYTES = 1 << 19, 8 << 20
#: Members of a group's block, and shingles of a family's: a task walks one pair of blocks.
GROUP, FAMILY = 1 << 13, 1 << 20
#: Bits of the filter that keeps texts of no pair out of an exchange.
FILTER_BITS = 1 << 24
#: Guards comparisons with products of the threshold; the similarity itself is compared as it is.
SLACK = 1e-9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _sets(texts: pa.Array, shingle: int, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingles, sorted by ``order`` (see _order) and hash, and where each text's begin, with the end."""
    words = Words(texts)
    words.data = _LOWER[words.data]
    counts = words.counts()
    hashes = words.hashes()
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    values = np.empty(len(doc), np.uint64)
    for size in range(1, shingle + 1):  # a shorter text is one shingle
        use = np.flatnonzero(np.minimum(counts, shingle)[doc] == size)
        values[use] = grams(hashes, size, at[use])
    by = np.lexsort((values, doc) if order is None else (values, _heat(values, order), doc))
    values, doc = values[by], doc[by]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


def _slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values & np.uint64(SLOTS - 1)).astype(np.int64), (values >> np.uint64(48)).astype(np.int64)


def _heat(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    a, b = _slots(values)
    return np.minimum(order[0][a], order[1][b])


def _order(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold the shingles of each slot: a Count-Min sketch of two rows over all texts, 1 MB on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                values, _ = _sets(part.column("text"), shingle, None)
                for row, slots in enumerate(_slots(values)):
                    total[row] += np.bincount(slots, minlength=SLOTS)
        return total

    return _summed(texts, run, 16 * SLOTS // SLICES, np.add).view(np.int64).reshape(2, SLOTS)


def _simhashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each set's fingerprint: a bit is 1 if more than half of its hashes have it; 0 for an empty set."""
    n = np.diff(first)
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        on = 2 * np.add.reduceat(bits, first[some], axis=0, dtype=np.int32) > n[some][:, None]
        out[some] = np.packbits(on, axis=1).view(">u8").reshape(-1)
    return out


def _fingerprints(values: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.array(_simhashes(x, first).view(np.int64)) for x in (values, mix(values ^ np.uint64(0x5851F42D4C957F2D))))


def _keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The digests of sets, of which each is sorted by hash."""
    return np.array([xxhash.xxh64_intdigest(values[a:z].tobytes()) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _prints(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(id, h, key, sim, sim2, n, prefix) of (id, h, text): the set's digest, fingerprints and size, and its first shingles where a task meets a set first."""
    order = _order(texts.select("text"), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                values, first = _sets(part.column("text"), shingle, order)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                keys = _keys(values[np.lexsort((values, doc))], first)
                head = np.where(n > 0, n - np.ceil(threshold * n - SLACK).astype(np.int64) + 1, 0)
                for d, key in enumerate(keys.tolist()):
                    if key in seen:
                        head[d] = 0
                    seen.add(key)
                offsets = np.concatenate([[0], np.cumsum(head)])
                at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], head)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[at].view(np.int64)))
                yield pa.record_batch([part.column("id"), part.column("h"), pa.array(keys), *_fingerprints(values, first), pa.array(n.astype(np.int32)), lists], ["id", "h", "key", "sim", "sim2", "n", "prefix"])

    return materialise(texts.mapInArrow(run, "id long, h long, key long, sim long, sim2 long, n int, prefix array<long>"), "prints")


def _shared(prints: DataFrame, buckets: int) -> DataFrame:
    """(s, key): the shingles that the prefixes of two sets have, with those sets; rows may repeat.

    A batch sends two entries at most for a shingle: the sets beyond that share it already and ride along.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn = [], 7919 * TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal turn
            s, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by = np.lexsort((key, s))
            s, key = s[by], key[by]
            rest = np.zeros(len(s), bool)
            rest[2:] = s[2:] == s[:-2]
            bucket = ((s[~rest] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows, out = [], []
            for b in np.flatnonzero(np.diff(edges)):
                a, z = edges[b], edges[b + 1]
                rows.append(int(b))
                out.append(b"\0" + pack(np.diff(s[~rest][a:z], prepend=np.uint64(0))) + pack(key[~rest][a:z]))
            for at in range(0, int(rest.sum()), FLUSH // 64):
                rows.append(turn % buckets)
                out.append(b"\1" + pack(s[rest][at : at + FLUSH // 64]) + pack(key[rest][at : at + FLUSH // 64]))
                turn += 1
            return pa.record_batch([pa.array(rows, pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            lists = batch.column("prefix")
            key = np.repeat(batch.column("key").to_numpy(), np.diff(lists.offsets.to_numpy()))
            held.append((lists.flatten().to_numpy().view(np.uint64), key))
            if sum(len(x) for x, _ in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        got: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        for raw in table.column("payload").to_pylist():
            n = (len(raw) - 1) // 16
            first, key = unpack(raw[1 : 1 + 8 * n], np.uint64, n), unpack(raw[1 + 8 * n :], np.int64, n)
            got[raw[0]].append((np.cumsum(first) if raw[0] == 0 else first, key))
        out = got[1]
        if got[0]:
            s, key = (np.concatenate(x) for x in zip(*got[0], strict=True))
            by = np.lexsort((key, s))
            s, key = s[by], key[by]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (key[1:] != key[:-1])
            s, key = s[new], key[new]
            twin = np.zeros(len(s), bool)
            twin[1:] = s[1:] == s[:-1]
            twin[:-1] |= twin[1:]
            out.append((s[twin], key[twin]))
        s, key = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.table({"s": pa.array(s.view(np.int64)), "key": pa.array(key)})

    sent = prints.where(F.size("prefix") > 0).select("key", "prefix").mapInArrow(send, "bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(settle, "s long, key long")


class _Likely:
    """Which pairs of sets may have the similarity: by size and both fingerprints. Two sets of 0.8 fail by about one in 10**5 (see the README)."""

    def __init__(self, sim: np.ndarray, sim2: np.ndarray, n: np.ndarray, threshold: float, budget: int):
        self.x, self.y, self.n, self.threshold, self.budget = sim.view(np.uint64), sim2.view(np.uint64), n, threshold, budget

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether, differing bits) of pairs of indexes."""
        first = np.bitwise_count(self.x[a] ^ self.x[b])
        both = first.astype(np.int64) + np.bitwise_count(self.y[a] ^ self.y[b])
        sizes = np.minimum(self.n[a], self.n[b]) >= self.threshold * np.maximum(self.n[a], self.n[b]) - SLACK
        return (first <= self.budget) & (both <= BOTH) & sizes, both


def _neighbours(rows: DataFrame, threshold: float, budget: int) -> DataFrame:
    """(u, v): likely pairs of a set and the one before it, or the first one, below a shingle; one pair for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first row of the last shingle here, and the last row
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("s", "key", "sim", "sim2", "n")]
            size = len(batch)
            if not size:
                continue
            if last is not None:
                cols = [np.concatenate([before, x]) for before, x in zip(last, cols, strict=True)]
            s, key, sim, sim2, n = cols
            at = np.arange(len(s) - size, len(s))
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            leader = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            last = [x[[leader[-1], len(s) - 1]] for x in cols]
            likely, out = _Likely(sim, sim2, n, threshold, budget), []
            for other in (at - 1, leader[at]):
                a, b = other[other >= 0], at[other >= 0]
                ok = likely(a, b)[0] & (s[a] == s[b]) & (key[a] != key[b])
                out.append((key[a][ok], key[b][ok]))
            u, v = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartitionByRange(parts, "s", "n", "key").sortWithinPartitions("s", "n", "key").mapInArrow(run, "u long, v long")
    return near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")


def _blocks(rows: DataFrame, group: int) -> DataFrame:
    """rows (s, key, ..., root) of groups with several roots, dealt out to tasks (s, kind, i, j): sides 0 and 1 of a pair of blocks.

    Kind 0 pairs the root that most members have with the rest, kind 1 the rest with itself.
    """
    by_root = rows.groupBy("s", "root").agg(F.count("*").alias("c"))
    groups = by_root.groupBy("s").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    dealt = lambda n: F.ceil(n / group).cast("int")
    groups = groups.select("s", F.col("top.root").alias("top"), dealt(F.col("top.c")).alias("m"), dealt(F.col("all") - F.col("top.c")).alias("r"))
    held = rows.join(groups, "s").withColumn("most", F.col("root") == F.col("top"))
    held = held.withColumn("b", F.pmod(F.xxhash64("key"), F.when(F.col("most"), F.col("m")).otherwise(F.col("r"))).cast("int"))
    task = F.expr(
        """CASE WHEN most THEN transform(sequence(0, r - 1), j -> struct(0 AS kind, b AS i, j AS j, 0 AS side))
           ELSE concat(transform(sequence(0, m - 1), i -> struct(0 AS kind, i AS i, b AS j, 1 AS side)),
                       transform(sequence(0, r - 1), j -> struct(1 AS kind, least(b, j) AS i, greatest(b, j) AS j, CASE WHEN b <= j THEN 0 ELSE 1 END AS side))) END"""
    )
    return held.withColumn("t", F.explode(task)).select("s", "t.*", "key", "sim", "sim2", "n", "root")


def _tasks(batches: Iterator[pa.RecordBatch], keys: list[str], weight, most: int) -> Iterator[pa.Table]:
    """Rows sorted by task, as tables of whole tasks: cut where one ends, once the rows' weight exceeds ``most``."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += weight(batch)
        if total >= most:
            table = pa.Table.from_batches(held)
            change = np.flatnonzero(np.any([np.diff(table.column(c).to_numpy()) != 0 for c in keys], axis=0))
            if len(change):
                cut = int(change[-1]) + 1
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                total = sum(map(weight, held))
    if any(len(b) for b in held):
        yield pa.Table.from_batches(held)


def _starts(cols: dict[str, np.ndarray], keys: list[str], itself: np.ndarray) -> tuple[np.ndarray, ...]:
    """The node pairs that a walk starts from, of rows sorted by task, side and fingerprint; ``itself``: tasks that pair one block."""
    new = np.ones(len(cols["side"]), bool)
    new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in keys], axis=0)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(new))
    first = np.concatenate([[0], np.cumsum(cols["side"] == 0)])
    mid, own = lo + first[hi] - first[lo], itself[lo]
    start = (lo, np.where(own, hi, mid), np.where(own, lo, mid), hi, np.zeros(len(lo), np.int64))
    live = (start[0] < start[1]) & (start[2] < start[3])
    return tuple(v[live] for v in start)


def _joined(tasks: DataFrame, threshold: float, budget: int, group: int) -> DataFrame:
    """(u, v): a spanning forest of each task's likely pairs of different roots."""
    keys = ["s", "kind", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tasks(batches, keys, len, 4 * group):
            cols = {c: table.column(c).to_numpy() for c in table.column_names}
            x = cols["sim"].view(np.uint64)
            by = np.lexsort((x, cols["side"], *(cols[c] for c in reversed(keys))))
            cols, x = {c: v[by] for c, v in cols.items()}, x[by]
            likely, label = _Likely(cols["sim"], cols["sim2"], cols["n"], threshold, budget), np.arange(len(x))
            for a, b in walk(x, _starts(cols, keys, (cols["kind"] == 1) & (cols["i"] == cols["j"])), 0, budget):
                ok = (cols["root"][a] != cols["root"][b]) & likely(a, b)[0]
                label = roots(label, a[ok], b[ok])
            tied = np.flatnonzero(label != np.arange(len(x)))
            u, v = cols["key"][tied], cols["key"][label[tied]]
            yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct()


def _summed(df: DataFrame, run, width: int, add) -> np.ndarray:
    """``run`` makes one array of SLICES * width bytes in each task; they are added up slice by slice and sent to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches).view(np.uint8).reshape(SLICES, width)
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["slice", "part"])

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("part").to_pylist():
            part = np.frombuffer(raw, np.int64)
            total = part if total is None else add(total, part)
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((SLICES, width), np.uint8)
    for row in df.mapInArrow(each, "slice int, part binary").groupBy("slice").applyInArrow(merge, "slice int, part binary").collect():
        out[row.slice] = np.frombuffer(row.part, np.uint8)
    return out.reshape(-1)


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A filter of 2 MB, whatever the input: bit h modulo its size is set for each h of rows (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_bit(batch.column("h"))] = True
        return np.packbits(bits, bitorder="little")

    return _summed(rows, run, FILTER_BITS // 8 // SLICES, np.bitwise_or)


def _bit(h: pa.Array) -> np.ndarray:
    return (h.to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def _members(family: DataFrame, prints: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the sets of ``family`` (key, ...), as a table.

    The sets are taken anew, from one text of each; a filter of bounded size keeps most other texts out of the exchange, the join the rest.
    """
    rows = prints.join(family.select("key"), "key").groupBy("key").agg(F.min(F.xxhash64("id", "h")).alias("h"))
    wanted = _bitmap(rows.select("h"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column("h"))
            use = batch.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in pieces(use, "text"):
                values, first = _sets(part.column("text"), shingle, None)
                yield pa.record_batch([pa.array(_keys(values, first)), *_fingerprints(values, first), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))], ["key", "sim", "sim2", "shingles"])

    found = texts.select(F.xxhash64("id", "h").alias("h"), "text").mapInArrow(build, "key long, sim long, sim2 long, shingles array<long>")
    return materialise(found.join(family, "key").dropDuplicates(["key"]), "sets")


def _verified(sets: DataFrame, threshold: float, budget: int, most: int) -> DataFrame:
    """(u, v): a spanning forest of the pairs of at least the similarity in each task, of (key, sim, sim2, shingles, family)."""
    size = sets.groupBy("family").agg(F.ceil(F.sum(F.size("shingles")) / most).cast("int").alias("m"))
    held = sets.join(size, "family").withColumn("b", F.pmod(F.xxhash64("key"), "m").cast("int"))
    task = F.expr("transform(sequence(0, m - 1), j -> struct(least(b, j) AS i, greatest(b, j) AS j, CASE WHEN b <= j THEN 0 ELSE 1 END AS side))")
    tasks = held.withColumn("t", F.explode(task)).select("family", "t.*", "key", "sim", "sim2", "shingles")
    keys = ["family", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tasks(batches, keys, lambda b: len(b.column("shingles").flatten()), most):
            table = table.combine_chunks()
            cols = {c: table.column(c).to_numpy() for c in table.column_names if c != "shingles"}
            lists = table.column("shingles").chunk(0)
            values, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            x = cols["sim"].view(np.uint64)
            by = np.lexsort((x, cols["side"], *(cols[c] for c in reversed(keys))))
            cols, x = {c: v[by] for c, v in cols.items()}, x[by]
            start, end = edges[:-1][by].tolist(), edges[1:][by].tolist()
            n = np.array(end) - np.array(start)
            likely, up = _Likely(cols["sim"], cols["sim2"], n, threshold, budget), list(range(len(x)))

            def root(k: int, up=up) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            for a, b in walk(x, _starts(cols, keys, cols["i"] == cols["j"]), 0, budget):
                ok, far = likely(a, b)
                near = np.flatnonzero(ok)
                near = near[np.argsort(far[near], kind="stable")]
                for p, q in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    r, t = root(p), root(q)
                    if r != t:
                        both = len(np.intersect1d(values[start[p] : end[p]], values[start[q] : end[q]], assume_unique=True))
                        if both / (end[p] - start[p] + end[q] - start[q] - both) >= threshold:
                            up[max(r, t)] = min(r, t)
            label = np.array([root(k) for k in range(len(x))], np.int64)
            tied = np.flatnonzero(label != np.arange(len(x)))
            u, v = cols["key"][tied], cols["key"][label[tied]]
            yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long").distinct()


def _rooted(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, F.col("key") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "key"))


def clusters(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, budget: int, group: int = GROUP, family: int = FAMILY) -> DataFrame:
    """(id, h, sim, key, root): the rows' ids and text hashes with the digest of their set and that of their component, as a table.

    Null ids are -2**63 here.
    """
    texts = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // BUCKET_BYTES)
    prints = _prints(texts, shingle, threshold)
    one = prints.where(F.size("prefix") > 0).groupBy("key").agg(*[F.first(c).alias(c) for c in ("sim", "sim2", "n")])
    rows = materialise(_shared(prints, buckets).distinct().join(one, "key").select("s", "key", "sim", "sim2", "n"), "met")
    first = materialise(_neighbours(rows, threshold, budget), "links")
    near = components(first)
    apart = materialise(_rooted(rows, near), "met")
    more = materialise(_joined(_blocks(apart, group), threshold, budget, group), "links")
    comp = components(first.union(more))
    sets = _members(comp.select(F.col("node").alias("key"), F.col("root").alias("family")), prints, texts, shingle)
    links = materialise(_verified(sets, threshold, budget, family), "links")
    final = components(links)
    found = materialise(_rooted(prints.select("id", "h", "sim", "key"), final).select("id", "h", "sim", "key", "root"), "clusters")
    discard(prints, rows, first, near, apart, more, comp, sets, links, final)
    return found
