"""Plain versions of vector codes and spelling variants, written from their contracts."""

import re
import zlib
from collections import Counter

import numpy as np


def vector_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector) without nulls -> ({id: (codes, error)}, codebooks)."""
    rows = sorted(rows)
    x = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64)
    pieces = np.array_split(x, parts, axis=1)
    books = [p[:entries].copy() for p in pieces]

    def nearest(p, b):
        return np.concatenate([((p[i:i + 200, None] - b[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(p), 200)])

    for _ in range(rounds):
        for p, b in zip(pieces, books):
            code, old = nearest(p, b), b.copy()
            for e in range(len(b)):
                if (code == e).any():
                    b[e] = old[e] if not (code == e).any() else p[code == e].sum(0) // (code == e).sum()
    codes = [nearest(p, b) for p, b in zip(pieces, books)]
    error = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(pieces, books, codes))
    return {r[0]: (tuple(int(c[i]) for c in codes), int(error[i])) for i, r in enumerate(rows)}, books


def spelling(docs, min_chars=6, min_count=5, ratio=5, slips=199):
    """{word: (form, root, n, n_near, form_n)}."""
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = form.get(w), root, n, len(links[w]), counts.get(form.get(w))
    return out, {(w, v) for w, vs in links.items() for v in vs}
