"""Plain Python versions of what the operators compute a column at a time."""

import re

import numpy as np
import pyarrow as pa

from perilgrid.llm.words import mix, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def line_ends(words):
    """After which words of a physical line a line ends: sentence ends, and the least hash of three words in each run of eight."""
    own = [int(word_hashes(pa.array([w]))[0][0]) for w in words]
    value = []
    for i, w in enumerate(words):
        h = own[i]
        for d in (1, 2):
            h = (h * 0xA24BAED4963EE407 + (own[i - d] if i >= d else 0)) % 2**64
        value.append(0 if w[-1] in ".!?" else int(mix(np.array([h], np.uint64))[0]))
    cuts = {i for i, w in enumerate(words) if w[-1] in ".!?"}
    return cuts | {min(range(a, a + 8), key=lambda i: (value[i], -i)) for a in range(len(words) - 7)}


def lines(text):
    """(words, start) of each line."""
    out = []
    for m in re.finditer(r"[^\n\r]+", text or ""):
        found = list(WORD.finditer(lower(m[0])))
        if not found:
            continue
        cut = [i + 1 for i in line_ends([w[0] for w in found])]
        edges = sorted({0, *[c for c in cut if c < len(found)], len(found)})
        for a, b in zip(edges, edges[1:]):
            out.append((tuple(w[0] for w in found[a:b]), m.start() + found[a].start()))
    return out


def dedup(docs):
    """docs: (id, text) without null ids, ids distinct -> {id: text}."""
    seen, result = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        ls = lines(text)
        drop, own = set(), []
        for k in range(len(ls) - 2):
            w = tuple(x[0] for x in ls[k : k + 3])
            if w in seen:
                drop |= {k, k + 1, k + 2}
            seen.add(w)
        if not drop:
            result[i] = text
            continue
        edges = [0, *[x[1] for x in ls[1:]], len(text)]
        result[i] = "".join(text[edges[k] : edges[k + 1]] for k in range(len(ls)) if k not in drop)
    return result


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
