"""Brute-force forms that several test modules use."""

import re


def components(rows):
    """rows: (id, text) -> {id: (number of shingles, smallest id that links reach)}; every sharing pair is compared."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    for a, b in {(a, b) for v in index.values() for k, a in enumerate(v) for b in v[k + 1 :]}:
        o = len(sets[a] & sets[b])
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    least = {}
    for i in sets:
        least[find(i)] = min(i, least.get(find(i), i))
    return {i: (len(s), least[find(i)]) for i, s in sets.items()}
