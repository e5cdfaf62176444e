"""Plain-Python versions of what the library computes, for small inputs."""

import math
from collections import defaultdict


def components(edges):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(parent)}


def clusters(ids, pairs, is_core, border="bridge", weight=None, own=0):
    """``{id: (n, core, cluster)}`` from unordered neighbour pairs."""
    n = {i: own for i in ids}
    near = defaultdict(list)
    for a, b in pairs:
        w = weight[(a, b)] if weight else 1
        n[a] += w
        n[b] += w
        near[a].append(b)
        near[b].append(a)
    core = {i for i in ids if is_core(n[i])}
    if border == "bridge":
        label = components([(a, b) for a in core for b in near[a]] + [(a, a) for a in core if own])
    else:
        label = components([(a, a) for a in core] + [(a, b) for a in core for b in near[a] if b in core])
        claims = {i: [label[c] for c in near[i] if c in core] for i in ids if i not in core}
        label.update({i: min(c) for i, c in claims.items() if c})
    return {i: (n[i], i in core, label.get(i, -2)) for i in ids}


def tfidf(tokens):
    """``{id: {term: w}}`` of ``{id: [token]}``."""
    df = defaultdict(int)
    for words in tokens.values():
        for t in set(words):
            df[t] += 1
    m = len(tokens)
    out = {}
    for i, words in tokens.items():
        vector = {}
        for t in set(words):
            w = words.count(t) * (math.log((m + 1) / (df[t] + 1)) if df[t] >= 2 else 0.0)
            if w:
                vector[t] = w
        out[i] = vector
    return out


def cosine(a, b):
    dot = sum(w * b[t] for t, w in a.items() if t in b)
    norm = math.sqrt(sum(w * w for w in a.values())) * math.sqrt(sum(w * w for w in b.values()))
    return round(dot / norm, 9) if norm else 0.0
