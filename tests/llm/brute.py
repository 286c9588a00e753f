"""Brute-force versions for the tests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def line_dedup(docs, least):
    lines = [(t or "").split("\n") for _, t in docs]
    key = lambda x: lower(x.strip(SPACE))
    count = Counter(k for x in lines for k in {key(y) for y in x})
    out = []
    for (d, _), x in zip(docs, lines, strict=True):
        kept = [y for y in x if not (len(key(y)) >= 1 and count[key(y)] >= least)]
        out.append((d, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def suffix(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, f in zip(r, gone, strict=True) if not f)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, kept))
    return out


def quality(text):
    text = text or ""
    w = words(text)
    n = len(w)
    tri = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    hit = {j for i in range(n - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def group_pages(pages, least=0):
    first = {}
    for p, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    return first
