"""Plain versions that the operators are held against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])


def components(texts, k, percent=80):
    """id -> smallest id reachable over links of equal enough sets."""
    sets = {i: set(shingles(t, k)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in seen.get(s, ()))
        for s in sets[i]:
            seen.setdefault(s, []).append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, sets


def leaks(texts, items, k=5, least=0.8):
    """(doc, item) -> best weighted similarity of a window, over all windows."""
    out = {}
    for d, t in texts.items():
        w = words(t)
        for i, item in items.items():
            v = words(item)
            if not v or not w:
                continue
            n = min(k, len(v))
            a = Counter(tuple(v[j : j + n]) for j in range(len(v) - n + 1))
            size = min(len(v), len(w))
            if len(w) < n:
                continue
            for p in range(len(w) - size + 1):
                b = Counter(tuple(w[p + j : p + j + n]) for j in range(size - n + 1))
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= least:
                    out[d, i] = max(out.get((d, i), 0), s)
    return out
