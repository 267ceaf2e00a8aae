"""Small documents with hostile cases, and brute-force twins of the operators."""

import random
import re
from collections import Counter

SPACE = "[^\\x20\\x09-\\x0D]+"
COMMON = "the of and to in is was for on with as by at from that this".split()


def words(text):
    return re.findall(SPACE, text or "")


def prose(rng, n):
    pool = COMMON + ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(pool) for _ in range(n))


def corpus(seed=1, groups=6, copies=5):
    """(doc_id, text) with exact copies, near copies, shared passages, short, blank, null and long texts and rows without an id."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 30)
    for _ in range(groups):
        base = words(prose(rng, rng.choice([4, 30, 120, 400])))
        for k in range(copies):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                near[rng.randrange(len(near))] = rng.choice(["CHANGED", "another", "é…ü"])
            rows.append(" ".join(near) if k % 2 else "\n".join(near))
    rows += [prose(rng, 60) + " " + passage + "\n" + prose(rng, 60) for _ in range(6)]
    rows += ["", None, "   \n\t", "one", "One", "two words", "a b c", "A b C", "x" * 200, "ab " * 3000, "ab " * 3001, prose(rng, 6000)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    out = list(zip(ids, rows))
    return out + [out[0], out[3], (None, rows[1]), (None, "only here without an id")]


def shingle_set(text, k):
    w = [x.encode().lower() for x in words(text)]
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(rows, k, num, den):
    """Smallest doc_id reachable, by comparing all pairs."""
    named = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(named):
        for j, t in named[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def repeats(rows, need):
    """(bytes, removed, spans, kept bytes) of each row."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        if i is not None:
            for p in range(len(raw) - need + 1):
                w = raw[p : p + need]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        if i is not None:
            for p in range(len(raw) - need + 1):
                if first[raw[p : p + need]] < i:
                    gone[p : p + need] = b"\1" * need
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def as_bag(rows):
    return Counter(map(tuple, rows))
