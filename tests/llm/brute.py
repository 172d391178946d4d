"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash


def fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    parts = [found[i : i + words] for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Least node that can be reached, for each node."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_groups(docs, radius=2):
    """doc_id to the least doc_id of its component; docs: (doc_id, text)."""
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    return groups(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= radius])


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def dedup_lines(docs, least=8):
    """doc_id to the text that is left; docs: (doc_id, text), each doc_id once."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            name = line.strip(" \t\r\x0b\x0c")
            words = name.split(" ")
            near = len(words) >= least and any(
                len(o) >= least and abs(len(o) - len(words)) <= 1 and len(set(o) & set(words)) >= least - 4 and word_distance(o, words) <= 1
                for o in seen.values()
            )
            if name and (name in seen or near):
                pass
            else:
                kept.append(line)
            if name:
                seen.setdefault(name, words)
        out[doc] = "\n".join(kept)
    return out


def passages(docs, items, similar=0.8, k=5):
    """(doc_id, item_id) with a window of as many words as the item and the similarity."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    known = {i: words(t) for i, t in items}
    by_shingle = defaultdict(set)
    for i, w in known.items():
        for s in shingles(w):
            by_shingle[s].add(i)
    found = set()
    for doc, text in docs:
        w = words(text)
        for i in set().union(*(by_shingle.get(s, set()) for s in shingles(w))):
            n, want = len(known[i]), shingles(known[i])
            for at in range(len(w) - n + 1):
                both = sum((shingles(w[at : at + n]) & want).values())
                if both / (2 * (n - k + 1) - both) >= similar:
                    found.add((doc, i))
                    break
    return found
