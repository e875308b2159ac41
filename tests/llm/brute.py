"""Plain restatements of the operators, for small fixtures."""

import collections
import hashlib
import re

WORD = "[^\x20\x09-\x0D]+"
A_Z = {c: c + 32 for c in range(65, 91)}


def groups(n, pairs, ids):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least[find(k)] for k in range(n)]


def jaccard(rows, width=5):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").translate(A_Z))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width
                    else {tuple(w)} if w else set())
    by, pairs = collections.defaultdict(list), []
    for k, s in enumerate(sets):
        shared = collections.Counter()
        for g in s:
            shared.update(by[g])
            by[g].append(k)
        pairs += [(k, j) for j, o in shared.items() if 100 * o >= 75 * (len(s) + len(sets[j]) - o)]
    ids = [i for i, _ in rows]
    return sorted(zip(ids, map(len, sets), groups(len(rows), pairs, ids), strict=True))


def repeated(units, length):
    """Flags of the elements covered by windows that start twice."""
    count = collections.Counter(tuple(u[p:p + length]) for u in units for p in range(len(u) - length + 1))
    out = []
    for u in units:
        flags = [False] * len(u)
        for p in range(len(u) - length + 1):
            if count[tuple(u[p:p + length])] > 1:
                flags[p:p + length] = [True] * length
        out.append(flags)
    return out


def bytes_dedup(rows, length):
    units = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), u, f in zip(rows, units, repeated(units, length), strict=True):
        kept = bytes(x for x, gone in zip(u, f, strict=True) if not gone)
        spans = sum(f[k] and (k == 0 or not f[k - 1]) for k in range(len(f)))
        out.append((i, len(u), sum(f), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words_dedup(rows, length):
    units = [re.findall(WORD, t or "") for _, t in rows]
    out = []
    for (i, _), u, f in zip(rows, units, repeated(units, length), strict=True):
        kept = " ".join(x for x, gone in zip(u, f, strict=True) if not gone)
        out.append((i, len(u), sum(f), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def mutated(prose, text, n):
    """The text with n words exchanged."""
    words = text.split(" ")
    for _ in range(n):
        words[prose.rng.randrange(len(words))] = prose(1)
    return " ".join(words)
