"""Plain restatements of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), doc))
    return {(doc, min(groups[n])[1], len(groups[n]), min(groups[n])[1] == doc, sha(n)) for doc, text in docs for n in [WHITE.sub("", text or "")]}


def near(docs, k=4, num=85, den=100):
    sets = {}
    for doc, text in docs:
        w = WORDS.findall(lower(text))
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {(d, len(sets[d]), find(d)) for d in ids}


def _cover(seq, width, seen):
    hit = [False] * len(seq)
    for i in range(len(seq) - width + 1):
        if seen[tuple(seq[i : i + width])] > 1:
            hit[i : i + width] = [True] * width
    return hit


def word_repeats(docs, width=35):
    words = {doc: WORDS.findall(text or "") for doc, text in docs}
    seen = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = set()
    for doc, w in words.items():
        hit = _cover(w, width, seen)
        out.add((doc, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h))))
    return out


def byte_repeats(docs, width=200):
    data = {doc: (text or "").encode() for doc, text in docs}
    seen = Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = set()
    for doc, b in data.items():
        hit = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                hit[i : i + width] = [True] * width
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.add((doc, len(b), sum(hit), runs, sha(bytes(x for x, h in zip(b, hit) if not h))))
    return out


def phrases(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall(lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    lengths = {len(x) for x in windows}
    out = set()
    for doc, text in docs:
        w = PLAIN.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= owners
        out.add((doc, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def thue_morse(n=1024, swap=False):
    """Letters a and b whose stretches cancel in polynomial hashes modulo 2**64."""
    return "".join("ab"[(i.bit_count() & 1) ^ swap] for i in range(n))
