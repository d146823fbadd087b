"""Brute-force versions of the training-data operators."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def passages(docs, window=50):
    first, words = {}, {d: WORD.findall(t or "") for d, t in docs}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def equal(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    return {d: (min(v)[1], len(v), d == min(v)[1], sha(k)) for k, v in groups.items() for _, d in v}


def byte_runs(docs, window=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(b[i : i + window])
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def near(docs, percent=85):
    sets = {}
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (n := len(sets[a] & sets[b])) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return {d: (len(sets[d]), least[d], least[d] == d) for d in ids}
