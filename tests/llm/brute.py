"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter, defaultdict

DATA = "/root/testdata"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def jaccard_groups(rows, shingle, num, den):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    root, least = components(len(rows), pairs), defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(least[root[i]])) for i in range(len(rows)))


def cut_repeats(rows, length):
    texts = [(i, words(t, lower=False)) for i, t in rows]
    seen = Counter(tuple(w[s : s + length]) for _, w in texts for s in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)
