"""Plain versions of the operators, for small inputs."""
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=4):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def jaccard_components(rows, size=4, pct=85):
    """rows of (doc_id, text) -> list of (doc_id, n, component)."""
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    for i, (_, s) in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x] if j < i)
        for j, c in common.items():
            if 100 * c >= pct * (len(s) + len(sets[j][1]) - c):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [(d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def removed_mask(rows, size=100):
    """rows of (doc_id, bytes) with distinct ids -> {doc_id: list of bools}."""
    seen, out = set(), {}
    for d, b in sorted(rows):
        mask = [False] * len(b)
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            if w in seen:
                mask[i:i + size] = [True] * size
            seen.add(w)
        out[d] = mask
    return out


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, size=10):
    """-> list of (doc_id, n_words, n_hit, item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH.findall((text or "").translate(ASCII_LOWER))
        if 0 < len(w) < size:
            windows[tuple(w)].add(item)
        for i in range(len(w) - size + 1):
            windows[tuple(w[i:i + size])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for d, text in rows:
        w = BENCH.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), found))
    return out
