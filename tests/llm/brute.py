"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def alnum(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def phrases(rows, length):
    first, words = {}, {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), (d, i))
    out = {}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = b"\1" * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), sha(kept), kept.decode())
    return out


def spans(rows, length):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def contamination(rows, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m and item is not None else 0):
            windows[tuple(w[i : i + m])].add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in rows:
        w = alnum(text)
        hit, found = bytearray(len(w)), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (got := windows.get(tuple(w[i : i + m]))) is not None:
                    found |= got
                    hit[i : i + m] = b"\1" * m
        n = sum(hit)
        out[d] = (len(w), n, len(found), sorted(found), n > 0 and 20 * n >= len(w))
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar_documents(rows, size, threshold):
    sets = {}
    for d, t in rows:
        w = alnum(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    degree = Counter(x for pair in links for x in pair)
    root = components(sets, links)
    return {d: (degree[d], root[d]) for d in sets}


def similar_vectors(rows, threshold):
    import math

    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            n = math.sqrt(sum(x * x for x in v))
            ok[i] = ([x / n for x in v], label)
    links = [(a, b) for a, b in combinations(sorted(ok), 2) if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and sum(x * y for x, y in zip(ok[a][0], ok[b][0])) >= threshold]
    degree, root = Counter(x for pair in links for x in pair), components([i for i, _, _ in rows], links)
    return {i: (degree[i], root[i]) for i, _, _ in rows}


def warc(rows, least):
    payload = {p: (h or "").encode() for p, _, h in rows}
    best = {}
    for p, b in payload.items():
        best[b] = max(best.get(b, p), p)
    return {p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if len(b) >= least and best[b] != p else "response", best[b] if len(b) >= least and best[b] != p else None) for p, b in payload.items()}


def best_fit(lengths, capacities, cost):
    """(bin, position, capacity) of each piece: longest first, into the fullest bin it fits, of these the one used last."""
    out, bins = {}, []  # a bin: [room, last use, used]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for turn, i in enumerate(order):
        size, later = lengths[i], [lengths[j] for j in order[turn + 1 :]]
        fitting = [b for b in bins if b[0] > 0 and b[0] >= size]
        if fitting:
            chosen = min(fitting, key=lambda b: (b[0], -b[1]))
        else:
            price = lambda c: cost(c) / max(1, size + min(c - size, sum(n for n in later if n <= c - size)))
            chosen = [min((c for c in capacities if c >= size), key=price), 0, 0]
            bins.append(chosen)
        out[i] = next(k for k, b in enumerate(bins) if b is chosen), chosen[2]
        chosen[0], chosen[1], chosen[2] = chosen[0] - size, turn, chosen[2] + size
    fits = [min(c for c in capacities if c >= b[2]) for b in bins]
    return [(*out[i], fits[out[i][0]]) for i in range(len(lengths))]


def packed(rows, capacities, cost):
    """(doc_id, piece, start, length, bin, capacity, position) of documents of the given lengths, in one shard."""
    most = max(capacities)
    pieces = [(d, k, k * most, min(most, n - k * most)) for d, n in rows for k in range(max(1, -(-n // most)))]
    pieces.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    return [(*x, b, c, at) for x, (b, at, c) in zip(pieces, best_fit([x[3] for x in pieces], capacities, cost))]
