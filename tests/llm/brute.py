"""Plain versions of the operators, written from their contracts."""

import hashlib
import re

import xxhash


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeats(docs, window=20):
    """{doc_id: (n_words, n_removed, sha of kept)} for distinct ids."""
    words = {d: blank_words(t) for d, t in docs}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s:s + window]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (d, s):
                gone.update(range(s, s + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items, window=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))

    index = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            index.setdefault(tuple(w[s:s + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in index}:
            for s in range(len(w) - n + 1):
                if (names := index.get(tuple(w[s:s + n]))):
                    hit.update(range(s, s + n))
                    found |= names
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def fingerprint(text, shingle=3):
    w = blank_words(lower_ascii(text))
    runs = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(fps, bits=2):
    """{id: smallest id reachable over links of at most ``bits`` bits}."""
    up = {d: d for d in fps}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in ids}
