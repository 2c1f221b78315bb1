"""Small documents with awkward rows, and brute-force versions of the operators' results."""

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row string, segment string, _id string, owner string"
WORDS = ["alpha", "beta", "Gamma", "delta", "été", "naïve", "x1", "zeta.", "the", "of", "and", "ß", "日本", "Theta"]


def documents() -> list[tuple]:
    draw = random.Random(4)
    prose = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    base = prose(120).split()
    passage = prose(60)
    texts = [None, "", "   \n\t ", "one", "two words", "three little words", prose(4), prose(5), prose(12), prose(13), prose(14)]
    texts += [" ".join(base)] * 5
    for k in range(12):
        other = list(base)
        for _ in range(k):
            other[draw.randrange(len(other))] = draw.choice(WORDS)
        texts.append(" ".join(other))
    texts += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(8)]
    texts += [passage + " " + passage, "na " * 200, prose(20000), "a" * 5000, "...", "123 456", "one\x0btwo\x0cthree\rfour five"]
    texts += [prose(draw.randrange(1, 60)) for _ in range(30)]
    rows = [(k * 3 + 1, t, draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s2", "s2", None]), len(t or ""), 0.5, "x", "y", "z", "w", "o") for k, t in enumerate(texts)]
    rows.append(rows[12])
    return rows


def spaced(text) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lowered(raw: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def repeats(rows, window=13) -> dict:
    least, words = {}, {}
    for i, t in rows:
        words[i] = w = spaced(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def shingles(text) -> set:
    w = spaced(lowered((text or "").encode()).decode())
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(rows, percent=75) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = defaultdict(int)
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def contamination(rows, items, size=10) -> dict:
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered((t or "").encode()))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
