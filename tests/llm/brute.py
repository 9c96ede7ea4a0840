"""Plain Python versions of operators that SQL cannot express."""

from __future__ import annotations

from collections import Counter, defaultdict


def kept_after_bytes(texts: dict, length: int) -> dict:
    """Per id: marks of bytes covered by a string that also starts earlier."""
    seen, out = set(), {}
    for i in sorted(texts, key=lambda x: (x is not None, x)):
        raw = (texts[i] or "").encode()
        marks = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                marks[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        out[i] = marks
    return out


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def repeated_word_marks(texts: dict, size: int) -> dict:
    count = Counter(tuple(w[s : s + size]) for w in map(words, texts.values()) for s in range(len(w) - size + 1))
    out = {}
    for i, t in texts.items():
        w = words(t)
        marks = bytearray(len(w))
        for s in range(len(w) - size + 1):
            if count[tuple(w[s : s + size])] > 1:
                marks[s : s + size] = b"\1" * size
        out[i] = marks
    return out


def shingles(text, n: int) -> frozenset:
    w = words((text or "").encode().lower().decode())
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_components(texts: dict, n: int, percent: int) -> dict:
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(i for i in sets if i is not None):
        both = Counter(j for g in sets[i] for j in holders[g])
        for g in sets[i]:
            holders[g].append(i)
        for j, k in both.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def spans(marks: bytearray) -> list[tuple[int, int]]:
    out = []
    for p, m in enumerate(marks):
        if m and out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        elif m:
            out.append((p, p + 1))
    return out
