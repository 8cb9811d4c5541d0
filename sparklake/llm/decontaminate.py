"""Benchmark decontamination by SimHash windows.

For every benchmark item of m words, windows of m words slide over the documents. A window's SimHash fingerprint is taken
over its shingles of five words; an index of the items' fingerprints in blocks (each block is entered with every pattern at
most ``RADIUS // BLOCKS`` bits away) is certain to find all items within ``RADIUS`` bits. Those candidates are verified
nearest first by exact weighted shingle similarity: sum of minima over sum of maxima of the shingles' counts, at least
``threshold``. Similar windows may lie beyond the radius, so none is left out for that: a window of w shingles that reaches
similarity t shares at least 2 * t * w / (1 + t) of them with the item. Only windows with that many positions whose shingle
an item has are fingerprinted, and those the index doesn't meet are verified too, unless that number shows that they can't
better the best window that the document and item have by then.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklake.llm._text import NOT_ALNUM, Words, grams, pieces, small_batches

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 15
#: Shorter items are matched by their whole sequence of words.
MIN_WORDS = SHINGLE
#: Letters of scripts written without spaces: each is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\x{30FC}])"
#: Bytes of benchmark text that one pass holds on the driver and each executor; more items make more passes.
PASS_BYTES = 8 << 20


def _simhash(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of hashes[s:s + width] for each start: a bit is 1 if more than half of the hashes have it."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 13):
        s = starts[at : at + (1 << 13)]
        lo, hi = int(s.min()), int(s.max()) + width
        if hi - lo > 1 << 15 and len(s) > 1:  # far apart: take the parts alone
            half = len(s) // 2
            out[at : at + half] = _simhash(hashes, s[:half], width)
            out[at + half : at + len(s)] = _simhash(hashes, s[half:], width)
            continue
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((hi - lo + 1, BITS), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        on = 2 * (total[s - lo + width] - total[s - lo]) > width
        out[at : at + len(s)] = np.packbits(on, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def _words(texts: pa.Array) -> Words:
    """Runs of letters, digits and non-ASCII characters, lower-cased; letters of unspaced scripts one by one."""
    texts = pc.utf8_lower(texts)
    if pc.any(pc.match_substring_regex(texts, UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, UNSPACED, r" \1 ")
    return Words(texts, NOT_ALNUM)


class Items:
    """Benchmark items with their shingles and the multi-index of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = _words(pa.array([text for _, text in rows], pa.string()))
        counts = words.counts()
        hashes = words.hashes()
        shingles = grams(hashes, SHINGLE)
        self.ids, self.size, self.bags, prints = [], [], [], []
        for k in np.flatnonzero(counts >= MIN_WORDS):
            own = shingles[words.first[k] : words.first[k + 1] - SHINGLE + 1]
            self.ids.append(rows[k][0])
            self.size.append(int(counts[k]))
            self.bags.append(Counter(own.tolist()))
            prints.append(_simhash(own, np.zeros(1, np.int64), len(own))[0])
        self.prints = np.array(prints, np.uint64)
        self.sizes = np.array(self.size, np.int64)
        # items without a shingle: by the number of words, the hash of all of them with the items' places in ids
        self.whole: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero((counts > 0) & (counts < MIN_WORDS)):
            own = grams(hashes, int(counts[k]), words.first[k : k + 1])
            self.whole.setdefault(int(counts[k]), {}).setdefault(int(own[0]), []).append(len(self.ids))
            self.ids.append(rows[k][0])
        # each shingle with the items that have it
        pairs = sorted((s, k) for k, bag in enumerate(self.bags) for s in bag)
        self.shingle = np.array([s for s, _ in pairs], np.uint64)
        self.of_item = np.array([k for _, k in pairs], np.int64)

        # the multi-index of the fingerprints
        width = BITS // BLOCKS
        near = [sum(1 << b for b in flip) for n in range(RADIUS // BLOCKS + 1) for flip in combinations(range(width), n)]
        self.blocks: list[dict[int, np.ndarray]] = []
        for b in range(BLOCKS):
            table: dict[int, list[int]] = {}
            for k, fp in enumerate(self.prints.tolist()):
                for flip in near:
                    table.setdefault((fp >> (b * width) & ((1 << width) - 1)) ^ flip, []).append(k)
            self.blocks.append({key: np.array(v) for key, v in table.items()})

    def within(self, prints: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(indexes of prints, item, distances) of all items of ``size`` words within RADIUS bits."""
        width = BITS // BLOCKS
        fits = self.sizes == size
        met: dict[int, list[np.ndarray]] = {}
        for b, table in enumerate(self.blocks):
            keys, back = np.unique((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1), return_inverse=True)
            groups = np.split(np.argsort(back, kind="stable"), np.cumsum(np.bincount(back))[:-1])
            for key, at in zip(keys.tolist(), groups, strict=True):
                for item in table.get(key, ()):
                    if fits[item]:
                        met.setdefault(int(item), []).append(at)
        for item, parts in met.items():
            at = np.unique(np.concatenate(parts))
            far = np.bitwise_count(prints[at] ^ self.prints[item])
            yield at[far <= RADIUS], item, far[far <= RADIUS]


def _matches(words: Words, items: Items, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, similarity, distance, first word): the best window of each document and item."""
    n = len(words)
    hashes, doc_of = words.hashes(), words.doc_of()
    for size, table in items.whole.items():
        own = grams(hashes, size)
        seen = np.flatnonzero(np.isin(own, np.fromiter(table, np.uint64, len(table))))
        seen = seen[seen + size <= words.first[doc_of[seen] + 1]]
        _, at = np.unique(np.stack([doc_of[seen].astype(np.uint64), own[seen]]), axis=1, return_index=True)
        for s in seen[at].tolist():
            for item in table[int(own[s])]:
                yield int(doc_of[s]), item, 1.0, 0, s - int(words.first[doc_of[s]])
    if n < MIN_WORDS or not len(items.prints):
        return
    shingles = grams(hashes, SHINGLE)
    at = np.searchsorted(items.shingle, shingles)
    hits = np.flatnonzero(items.shingle[np.minimum(at, len(items.shingle) - 1)] == shingles)
    if not len(hits):
        return
    hits = hits[hits + SHINGLE <= words.first[doc_of[hits] + 1]]
    lo, hi = (np.searchsorted(items.shingle, shingles[hits], side=s) for s in ("left", "right"))
    which = np.repeat(np.arange(len(hits)), hi - lo)
    item_of = items.of_item[np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    of_hit = items.sizes[item_of]

    def windows(place: np.ndarray, size: int, need: float) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the windows that hold at least ``need`` of the positions, with how many each holds."""
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(place - size + SHINGLE, words.first[doc_of[place]]), 1)
        np.add.at(mark, place + 1, -1)
        held = np.cumsum(mark[:-1])
        starts = np.flatnonzero(held >= need)
        starts = starts[starts + size <= words.first[doc_of[starts] + 1]]
        return starts, held[starts]

    for size in np.unique(of_hit).tolist():
        width = size - SHINGLE + 1
        need = 2 * threshold * width / (1 + threshold) - 1e-9
        here = np.flatnonzero(of_hit == size)
        place = np.unique(hits[which[here]])
        starts, _ = windows(place, size, need) if len(place) >= need else (place[:0], None)
        if not len(starts):
            continue
        prints = _simhash(shingles, starts, width)
        near = {item: (starts[at], far) for at, item, far in items.within(prints, size)}
        here = here[np.argsort(item_of[here], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(item_of[here], prepend=-1)), len(here))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if z - a < need:
                continue
            item = int(item_of[here[a]])
            at, most = windows(hits[which[here[a:z]]], size, need)
            # the index's candidates come first, the nearest of them before the others
            met, far = near.get(item, (at[:0], at[:0]))
            _, own, its = np.intersect1d(at, met, assume_unique=True, return_indices=True)
            rank = np.full(len(at), BITS + 1)
            rank[own] = far[its]
            bag, best = items.bags[item], {}
            for j in np.lexsort((at, rank)).tolist():
                s, d = int(at[j]), int(doc_of[at[j]])
                held, first = best.get(d, (0, s))
                if most[j] < held or (most[j] == held and s > first):
                    continue
                own = Counter(shingles[s : s + width].tolist())
                both = sum(min(c, own[x]) for x, c in bag.items() if x in own)
                if both / (2 * width - both) >= threshold and (both > held or (both == held and s < first)):
                    best[d] = (both, s)
            for d, (both, s) in best.items():
                far = int(prints[np.searchsorted(starts, s)] ^ items.prints[item]).bit_count()
                yield d, item, both / (2 * width - both), far, s - int(words.first[d])


def _passes(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, collected in passes of a bounded size."""
    bench = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total // (PASS_BYTES // 2)) + 1
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r.id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_id, similarity, hamming, first_word) of each document and benchmark item that it holds.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; letters of scripts written without spaces are
    words of their own. Items of fewer than MIN_WORDS words match where all their words follow each other, with similarity
    1 and distance 0. Null and empty texts on either side match nothing. Documents are compared whole; each row of a repeated document gets its own
    results, with the best window for each item, of windows that tie the first. Equal items are found alike. A null id is returned as null. Other
    columns are left out, so none can clash. Texts may have any length. Empty tables give no rows.
    """
    found = None
    for rows in _passes(bench, item_col, item_text):
        items = Items(rows)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text"):
                    words = _words(part.column("text"))
                    got = list(_matches(words, items, threshold))
                    if got:
                        doc, item, like, far, at = zip(*got, strict=True)
                        yield pa.record_batch([part.column("id").take(pa.array(doc)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(like, pa.float64()), pa.array(far, pa.int32()), pa.array(at, pa.int64())], ["id", "item_id", "similarity", "hamming", "first_word"])

        part = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, item_id long, similarity double, hamming int, first_word long")
        found = part if found is None else found.union(part)
    return found.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "item_id", text_col: str = "text", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item: see ``contaminated``. Null texts stay."""
    for rows in _passes(bench, id_col, item_text):
        items = Items(rows)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, text_col):
                    words = _words(part.column(text_col))
                    held = np.ones(len(part), bool)
                    held[[d for d, *_ in _matches(words, items, threshold)]] = False
                    yield part.filter(pa.array(held))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
