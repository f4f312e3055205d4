"""Brute-force versions that several tests use."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhashes(texts):
    out = []
    for t in texts:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        found = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def components(ids, fps, most):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                up[find(i)] = find(j)
    return [min(ids[k] for k in range(len(ids)) if find(k) == find(i)) for i in range(len(ids))]


def removed_words(rows, window):
    """rows: (id, text) in order of ids. id: words, removed words, kept text."""
    seen, out = set(), {}
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out
