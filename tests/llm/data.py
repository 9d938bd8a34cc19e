"""Small tables with the awkward rows that every operator must handle, and plain references."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 9973}x{i}" for i in range(40_000))
BASE = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder about it all day long"

#: Columns whose names the operators use inside, to be passed by or ignored.
EXTRA = "score double, predicted int, key string, salt string, token string, rep string, norm string, size string"

ROWS = [
    (1, BASE, "en", "b"),
    (2, BASE.upper(), "en", "a"),
    (3, BASE + " indeed", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \t\n", "en", "c"),
    (7, "... 123 !!", None, "c"),
    (8, "short", "en", "é"),
    (8, "short", "en", "é"),
    (None, BASE, "en", "b"),
    (None, "nobody knows this one", "en", None),
    (9, LONG, "en", "b"),
    (10, LONG + " end", "en", "b"),
    (11, "Straße ÄÖ und der die das ist nicht", "de", "a"),
    (12, "Straße äö und der die das ist nicht", "de", "a"),
    (13, "two words", "en", "a"),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(*r, 9.5, 7, "k", "s", "t", "r", "n", "z") for r in rows],
        f"doc_id long, text string, lang string, source string, {EXTRA}",
    )


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near(rows, n, percent):
    """By id: (size of the set, smallest id reachable), by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}
    holders = defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}
