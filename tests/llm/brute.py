"""Plain reference versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, window=20):
    """rows: (doc_id, text), ids distinct."""
    seen, flagged = set(), Counter()
    out = {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
                flagged[doc] += 1
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def simhash(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    prints = {doc: simhash(text) for doc, text in rows}
    return prints, cluster(prints)


def cluster(prints, budget=3):
    distinct = sorted(set(prints.values()))
    up = {p: p for p in distinct}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= budget:
                up[root(p)] = root(q)
    least = {}
    for doc, p in prints.items():
        least[root(p)] = min(doc, least.get(root(p), doc))
    return {doc: least[root(p)] for doc, p in prints.items()}
