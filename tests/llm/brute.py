"""Plain versions of the operators, one row at a time, for small tables."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text, n=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, k=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def near_groups(texts):
    """texts by id to the smallest id of each one's group at a similarity of 0.8."""
    s = {d: shingles(t) for d, t in texts.items()}
    alike = lambda a, b: 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])
    return components(sorted(s), lambda a, b: len(s[a]) * 4 <= len(s[b]) * 5 and len(s[b]) * 4 <= len(s[a]) * 5 and alike(a, b))


def components(nodes, linked):
    """smallest member of each node's component; linked(a, b) on pairs."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = list(parent)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {x: find(x) for x in nodes}


def passages(rows, window=50):
    """rows: (doc_id, text). Per row (doc_id, n_words, n_removed, kept_sha256)."""
    key = lambda d: float("inf") if d is None else d
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def encoded(text, path, end):
    from tokenizers import Tokenizer

    if path not in encoded.__dict__:
        encoded.__dict__[path] = Tokenizer.from_file(path)
    t = encoded.__dict__[path]
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    import zlib

    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
