"""Plain restatements of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def classes(rows, k, percent=80):
    """{doc_id: smallest doc_id reachable} of (doc_id, text) rows."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) - 5:
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def line_dedup(rows, least=10):
    """{doc_id: (n_lines, n_dropped, sha256)} of (doc_id, text) rows with distinct ids."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), i), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repetition(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and repeated characters by n-gram length."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)

    def repeated(n):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        return {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}

    rep = len(repeated(8))
    chars = {n: sum(len(w[i]) for i in repeated(n)) for n in range(5, 11)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, rep, len(w) < 20 or 100 * rep > 30 * len(w), chars
