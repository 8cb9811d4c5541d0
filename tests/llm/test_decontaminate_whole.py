"""Windows at the stated similarity, against brute force."""

import random
import re
from collections import Counter

import pytest

from sparklake.llm import decontaminate
from tests.llm.test_operators import docs


def brute_windows(rows, bench, words=lambda t: re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", t.lower())):
    """Every window of every item of five words or more, without any constant of the operator."""
    found = {}
    for item, text in bench:
        m = words(text)
        bag = Counter(tuple(m[i : i + 5]) for i in range(len(m) - 4))
        for doc, t in rows:
            w = words(t)
            for s in range(len(w) - len(m) + 1):
                own = Counter(tuple(w[i : i + 5]) for i in range(s, s + len(m) - 4))
                like = sum((own & bag).values()) / sum((own | bag).values())
                if like >= 0.8:
                    found[doc, item] = max(like, found.get((doc, item), 0))
    return found


def test_edits_in_the_middle_are_found(spark):
    r = random.Random(41)
    items, rows = [], []
    for k in range(150):
        w = [f"t{r.randrange(10**6)}" for _ in range(r.randint(50, 59))]
        items.append((k, " ".join(w)))
        for j in range(3):
            leak = list(w)
            leak[r.randint(20, 30)] = f"changed{j}"
            rows.append((3 * k + j, " ".join(["before it", *leak, "and after"])))
    # a shingle that an item repeats counts once for each time, so fingerprints of near windows may lie far apart
    heavy = "go " * 14 + " ".join(f"h{i}" for i in range(60))
    items.append((500, heavy))
    rows.append((1000, "no " * 10 + "go " * 4 + " ".join(f"h{i}" for i in range(60))))
    rows.append((1001, "x " + heavy))
    want = brute_windows(rows[-6:], items[-2:])
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(docs(spark, [(i, t, "en", "s", 0) for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: x.similarity for k, x in got.items() if k[0] >= rows[-6][0] and k[1] in (149, 500)} == pytest.approx(want)
    assert {(3 * k + j, k) for k in range(150) for j in range(3)} <= set(got)
    # the case that was lost: similar windows whose fingerprints differ in more than 15 bits
    assert max(x.hamming for x in got.values()) > decontaminate.RADIUS


def test_short_and_unspaced_items(spark):
    items = [(1, "zq1 zq2 zq3 zq4 zq5"), (2, "ZQ6, zq7 zq8 zq9 zq10 zq11 zq12"), (3, "lone1"), (4, "pair1 pair2"), (5, "北京是中华人民共和国的首都"), (6, "東京タワーは高い"), (7, "四字成语"), (8, "!?"), (9, "lone1")]
    rows = [
        (1, "a zq1 zq2 zq3 zq4 zq5 b"),
        (2, "a zq6 zq7 zq8 zq9 zq10 zq11 zq12"),
        (3, "lone1 b lone1. pair1, PAIR2"),
        (4, "pair1 x pair2 lone12 zq1 zq2 zq3 zq4"),
        (5, "我们都知道北京是中华人民共和国的首都，对吗"),
        (6, "昨日東京タワーは高いと思った"),
        (7, "一个四字成语吧 pair1"),
        (8, "pair2 四字成 语北京是中华"),
        (9, None),
        (10, ""),
    ]
    df, bench = docs(spark, [(i, t, "en", "s", 0) for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.similarity) for x in decontaminate.contaminated(df, bench).collect())
    # words are letters where no spaces are written, so the fourth letter of document 8 still follows the third
    want = [(1, 1), (2, 2), (3, 3), (3, 4), (3, 9), (5, 5), (6, 6), (7, 7), (8, 7)]
    assert got == [(*x, 1.0) for x in want]
    assert {x.doc_id for x in decontaminate.clean(df, bench).collect()} == {4, 9, 10}
