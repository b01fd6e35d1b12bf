"""Plain restatements that the operators are held against."""

from __future__ import annotations

import re


class Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text: str | None, words: int = 5) -> set:
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def jaccard_components(texts: dict, percent: int = 80) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    union, ids = Union(texts), sorted(texts)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                union.join(ids[x], ids[y])
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def repeated_lines(texts: dict, min_words: int) -> dict:
    """Line numbers that lie in a run of lines, matched line by line with an earlier place, of enough words, and blank ones between."""
    rows = [(i, k, line.strip(), len(line.split())) for i, t in sorted(texts.items()) for k, line in enumerate((t or "").split("\n")) if line.split()]
    gone = {i: set() for i in texts}
    for p in range(len(rows)):
        for q in range(p):
            n = words = 0
            while p + n < len(rows) and q + n < len(rows) and rows[p + n][0] == rows[p][0] and rows[q + n][0] == rows[q][0] and rows[p + n][2] == rows[q + n][2]:
                words += rows[p + n][3]
                n += 1
            if words >= min_words:
                gone[rows[p][0]] |= {rows[p + k][1] for k in range(n)}
    for (i, k, *_), (j, m, *_) in zip(rows, rows[1:], strict=False):  # blank lines between two that go
        if i == j and k in gone[i] and m in gone[i]:
            gone[i] |= set(range(k, m))
    return gone


def word_edits(item: list, words: list) -> int:
    """Fewest edits between the item and any run of the words."""
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
