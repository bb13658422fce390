"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    found = WORD.findall(text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if lower else found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(docs, window=20):
    """{doc_id: (n_words, n_removed, kept_sha256)} of distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[doc_id] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, n=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(docs):
    """{doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def weighted(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common)


def leaks(docs, items, least=0.75):
    """{(doc_id, item_id)} by trying every window of the item's length."""
    found = set()
    for doc_id, text in docs:
        w = words(text, lower=True)
        for item_id, item in items:
            q = words(item, lower=True)
            if q and w and any(weighted(q, w[i : i + len(q)]) >= least for i in range(max(1, len(w) - len(q) + 1))):
                found.add((doc_id, item_id))
    return found


def shares(totals, most=3):
    """Targets of {source: size} by capping and sharing again."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(totals.values())), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * totals[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = float(most * totals[s])
            left -= target[s]
        open_ -= full
    return target
