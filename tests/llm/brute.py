"""Plain Python versions of the operators, over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(doc_id, n=5) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def hits(docs, items, k=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        size = min(k, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def language_model(docs):
    tokens = [(d, [*WORD.findall((t or "").translate(LOWER)), "\n"]) for d, t in docs]
    counts = Counter(w for d, ws in tokens if fold(d) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(d, fold(d) == 1, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens]


def repeats(docs, length=50):
    """docs in any order; ids may repeat; None comes after all others."""
    first: dict[bytes, float] = {}
    key = lambda d: math.inf if d is None else d
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, math.inf), key(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def near_classes(docs, least=0.8, k=5):
    """Class name of each row."""
    texts = sorted({t or "" for _, t in docs})
    bags = []
    for t in texts:
        w = WORD.findall(t)
        bags.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, bag in enumerate(bags):
        for s in bag:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            parent[find(b)] = find(a)
    number = {t: i for i, t in enumerate(texts)}
    names = {}
    for d, t in docs:
        if d is not None:
            c = find(number[t or ""])
            names[c] = min(names.get(c, d), d)
    return [(d, names.get(find(number[t or ""]))) for d, t in docs]
