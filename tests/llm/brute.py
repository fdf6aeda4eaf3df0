"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = float("inf")


def key(doc_id):
    return LAST if doc_id is None else doc_id


def measures(text):
    words = SPACE_WORDS.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            repeat |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if SPACE_WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)


def passages(rows, k=20):
    """{row: (n_words, n_removed, sha)}; rows are (doc_id, text)."""
    first = {}
    split = [SPACE_WORDS.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split):
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, (LAST, LAST)), (key(d), p))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (key(d), p):
                gone |= set(range(p, p + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def strings(rows, k=50):
    first = {}
    raw = [(t or "").encode() for _, t in rows]
    for (d, _), b in zip(rows, raw):
        for p in range(len(b) - k + 1):
            g = b[p : p + k]
            if key(d) < first.get(g, LAST + 1):
                first[g] = key(d)
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if first.get(b[p : p + k], LAST) < key(d):
                gone[p : p + k] = b"\x01" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def lower(text):
    return ITEM_WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def decontaminated(rows, items, k=10):
    grams = defaultdict(set)
    for item, text in items:
        w = lower(text)
        for p in range(max(len(w) - k + 1, 1) if w else 0):
            grams[tuple(w[p : p + k])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for d, text in rows:
        w, hit, seen = lower(text), set(), set()
        for p in range(len(w)):
            for n in sizes:
                if p + n <= len(w) and (g := tuple(w[p : p + n])) in grams:
                    hit |= set(range(p, p + n))
                    seen |= grams[g]
        names = ",".join(sorted(str(x) for x in seen if x is not None))
        out.append((d, len(w), len(hit), len([x for x in seen if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def classes(rows, size=5, threshold=0.8):
    """{row number: class number} by exact weighted Jaccard similarity of all pairs."""
    bags = []
    for _, t in rows:
        w = SPACE_WORDS.findall(t or "")
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        bags.append(Counter(grams))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = sum((bags[i] & bags[j]).values())
            if same or (both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= threshold):
                root[find(i)] = find(j)
                links += not same
    return [find(i) for i in range(len(rows))], links


def crc(text):
    return zlib.crc32((text or "").encode())
