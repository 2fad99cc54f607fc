"""Plain Python forms of the operators, for small inputs."""

import re

LAST = 2**63 - 1


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept text) of each row."""
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shingles(text):
    w = [re.sub(rb"[A-Z]", lambda m: m.group().lower(), x) for x in split(text)]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent):
    """doc_id -> component; rows of one id are one document."""
    sets = [(LAST if i is None else i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def value(key):
    return (key is None, 0 if key is None else key)
