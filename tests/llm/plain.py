"""Brute-force versions shared by tests."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """doc_id -> (set size, smallest doc_id reachable); doc_ids are unique here."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    overlap = defaultdict(int)
    for ids in having.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                overlap[a, b] += 1
    for (a, b), o in overlap.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
