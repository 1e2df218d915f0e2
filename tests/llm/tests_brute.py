"""Components over all pairs that share an n-gram."""

from collections import Counter, defaultdict


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = [shingles(t, n) for _, t in docs]
    held = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            held[g].append(k)
    common = Counter((a, b) for own in held.values() for i, a in enumerate(own) for b in own[i + 1 :])
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(docs))
