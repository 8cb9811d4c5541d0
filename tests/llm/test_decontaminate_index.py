"""Windows are met by the SimHash index first, and the index decides what is left to verify."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sparklake.llm import decontaminate


def brute_best(texts, bench):
    """(document, item): the similarity and first word of the best window, of those that tie the first."""
    found = {}
    for item, text in bench:
        m = re.findall(r"\w+", text)
        bag = Counter(tuple(m[i : i + 5]) for i in range(len(m) - 4))
        for doc, t in enumerate(texts):
            w = re.findall(r"\w+", t)
            for s in range(len(w) - len(m) + 1):
                own = Counter(tuple(w[i : i + 5]) for i in range(s, s + len(m) - 4))
                like = sum((own & bag).values()) / sum((own | bag).values())
                if like >= 0.8 and like > found.get((doc, item), (0,))[0]:
                    found[doc, item] = like, s
    return found


def corpus():
    r = random.Random(12)
    bench = [(k, " ".join(f"a{r.randrange(60)}" for _ in range(20 + k % 3 * 15))) for k in range(12)]
    bench += [(20, "again " * 30), (21, bench[0][1])]
    texts = ["again " * 50, ""]
    for k in range(60):
        w = bench[k % 12][1].split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "other"
        twice = [*w, "then", *w] if k % 5 == 0 else w
        texts.append(" ".join([*(f"b{r.randrange(9)}" for _ in range(r.randrange(40))), *twice, "end"]))
    return texts, bench


def matches(texts, bench):
    items = decontaminate.Items(bench)
    found = decontaminate._matches(decontaminate._words(pa.array(texts)), items, 0.8)
    return {(d, items.ids[i]): (like, far, at) for d, i, like, far, at in found}


def test_windows_come_through_the_index(monkeypatch):
    met, within = [], decontaminate.Items.within

    def watched(self, prints, size):
        for at, item, far in within(self, prints, size):
            met.append((self.ids[item], len(at)))
            yield at, item, far

    monkeypatch.setattr(decontaminate.Items, "within", watched)
    texts, bench = corpus()
    got = matches(texts, bench)
    assert {k: (like, at) for k, (like, _, at) in got.items()} == {k: (pytest.approx(x), at) for k, (x, at) in brute_best(texts, bench).items()}
    assert {item for (_, item), (_, far, _) in got.items() if far <= decontaminate.RADIUS} <= {item for item, n in met if n}


def test_similar_windows_beyond_the_radius():
    r = random.Random(41)
    bench, texts = [], []
    for k in range(300):
        w = [f"t{r.randrange(10**6)}" for _ in range(r.randint(50, 59))]
        bench.append((k, " ".join(w)))
        w[r.randint(20, 30)] = "changed"
        texts.append(" ".join(["before it", *w, "and after"]))
    got = matches(texts, bench)
    assert {(k, k) for k in range(300)} <= set(got)
    assert max(far for _, far, _ in got.values()) > decontaminate.RADIUS


def test_nothing_depends_on_what_the_index_meets(monkeypatch):
    texts, bench = corpus()
    want = matches(texts, bench)
    monkeypatch.setattr(decontaminate.Items, "within", lambda self, prints, size: iter(()))
    assert matches(texts, bench) == want


def test_candidates_spare_the_others(monkeypatch):
    """A copy is met at distance 0, and the windows around it can't better it."""
    seen = []
    monkeypatch.setattr(decontaminate, "Counter", lambda x: seen.append(1) or Counter(x))
    item = " ".join(f"w{i}" for i in range(100))
    items, words = decontaminate.Items([(1, item)]), decontaminate._words(pa.array([f"{'before ' * 50}{item}{' after' * 50}"]))
    seen.clear()
    assert [m[2:] for m in decontaminate._matches(words, items, 0.8)] == [(1.0, 0, 50)] and len(seen) == 1
