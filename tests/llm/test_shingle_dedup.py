"""Near-duplicates of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparklake.llm import shingle_dedup
from tests.llm import brute
from tests.llm.test_operators import DOCS


def brute_components(rows):
    sets, up = {}, {}
    for doc, text in rows:
        w = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc], up[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}, doc

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: root(d) for d in sets}


def near_copies(seed=21):
    """Texts with one to eight words changed, around the threshold; templates; short, empty and equal ones."""
    r = random.Random(seed)
    rows = []
    line = " ".join(f"line{i}" for i in range(30))
    for i in range(25):
        base = [f"v{r.randrange(5000)}" for _ in range(r.choice([30, 60, 100, 200, 400]))]
        for _ in range(8):
            w = list(base)
            for at in r.sample(range(len(w)), r.randint(0, 8)):
                w[at] = f"new{r.randrange(5000)}"
            rows.append(" ".join(w[: len(w) - r.randrange(4)]))
        rows.append(line + " " + " ".join(f"own{r.randrange(9000)}" for _ in range(r.choice([3, 6, 20]))))
    rows += ["a b", "A  b", "a b c", "a b c d e", "a b c d e f", "", None, " "]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_stage_links_from_the_stated_similarity(spark):
    rows = near_copies()
    want = brute_components(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df.repartition(5), "").collect()}
    assert got == {d for d, c in want.items() if d == c}
    # SimHash of three words within 3 bits keeps most of these near copies
    _, by_print = brute.near_duplicates(rows)
    assert sum(d == c for d, c in by_print.items()) > len(got) + 20
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").collect() == []


def test_blocks_of_groups_and_families_lose_nothing(spark):
    # every group and family is dealt over many tasks
    rows = near_copies(22)
    want = brute_components(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    found = shingle_dedup.clusters(df, "doc_id", "text", 5, 0.8, shingle_dedup.BUDGET, group=3, family=500).collect()
    comps, least = {x.id: x.root for x in found}, {}
    for d, c in comps.items():
        least[c] = min(d, least.get(c, d))
    assert {d: least[c] for d, c in comps.items()} == want


def test_stage_keeps_one_of_equal_rows_and_of_rows_without_an_id(spark):
    text, other = near_copies()[0][1] + " and more", " ".join(f"other{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (None, other), (None, other), (5, other + " x"), (7, None), (7, None), (8, ""), (9, "alone")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("key", F.lit(1))
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(5, text), (5, other + " x"), (7, None), (9, "alone")], key=str)


def test_likely_pairs_hold_those_of_the_similarity():
    """Sets at the threshold fail by size or fingerprints less than once in 10**4, whatever their size."""
    r = np.random.default_rng(3)
    for n, changed in ((5, 1), (9, 1), (30, 3), (200, 22)):
        a = r.integers(0, 1 << 64, (4000, n), np.uint64)
        b = a.copy()
        b[:, :changed] = r.integers(0, 1 << 64, (4000, changed), np.uint64)
        if n == 5:
            b = b[:, 1:]
        both = [np.concatenate([x.reshape(-1) for x in (a, b)]), np.concatenate([[0], np.cumsum([a.shape[1]] * 4000 + [b.shape[1]] * 4000)])]
        sim, sim2 = (x.to_numpy() for x in shingle_dedup._fingerprints(*both))
        likely = shingle_dedup._Likely(sim, sim2, np.diff(both[1]), 0.8, shingle_dedup.BUDGET)
        assert (~likely(np.arange(4000), np.arange(4000, 8000))[0]).sum() <= 1
        # and sets with nothing in common hardly ever pass
        assert likely(np.arange(3999), np.arange(4001, 8000))[0].sum() <= 10
