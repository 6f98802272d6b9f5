"""Plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction


def components(texts, percent=85):
    """id -> (set size, smallest id reachable)."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for e in s:
            holders.setdefault(e, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_words(texts, window=20):
    """id -> (words, set of places that a repeated window covers)."""
    seen, out = {}, {}
    for i, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for a in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[a : a + window]), (i, a)) != (i, a):
                gone.update(range(a, a + window))
        out[i] = (w, gone)
    return out


def repeats(texts, window=20):
    """id -> (words, removed, sha256 of what is left)."""
    return {i: (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()) for i, (w, gone) in kept_words(texts, window).items()}


def base_spans(text):
    """Secrets of the three base kinds by walking the text, as kind:start:end joined by commas."""
    found = []
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def run(i, letters):
        while i < len(text) and text[i] in letters:
            i += 1
        return i

    i = 0
    while i < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(k)].lower() == k and text[i : i + len(k)].isascii()), None)
        j = i + len(key or "")
        j += text[j : j + 1] in ("'", '"')
        j = run(j, " ")
        if key and text[j : j + 1] in (":", "="):
            j = run(j + 1, " ")
            j += text[j : j + 1] in ("'", '"')
            end = run(j, allowed)
            if end > j:
                if end - j >= 6:
                    found.append((i, 0, end))
                i = end
                continue
        i += 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        end = run(i, upper)
        if end - i >= 20:
            found.append((i, 1, end))
        i = max(end, i + 1)
    i = 0
    while i < len(text):
        end = run(i, set("0123456789abcdef"))
        if end - i >= 24:
            found.append((i, 2, end))
        i = end + 1
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def log_probability(word, p):
    """log of the sum over all segmentations of a word's bytes, in exact fractions; p: piece -> probability."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[a] * Fraction(p[word[a:end]]) for a in range(end) if word[a:end] in p))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def segmentations(word, pieces):
    """All ways to cut a word into pieces."""
    if not word:
        return [[]]
    return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in pieces for rest in segmentations(word[k:], pieces)]


def least_packing(sizes, lengths, overhead):
    """The least cost of any packing, by trying all."""
    best = math.inf

    def place(i, bins):
        nonlocal best
        if i == len(sizes):
            best = min(best, sum(min(c for c in lengths if c >= b) + overhead for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= max(lengths):
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def tree(text, digest, word_ends, fine=16, most=16, section=64):
    """(root's preimage, [(section hash, leaves)]) of the Merkle tree over a text, from its description."""
    parts, line_start = [], 0
    lines = text.splitlines(keepends=True)
    for line in lines:
        held, count = "", 0
        rest = line
        while rest:
            # White space, a word, or white space that ends the line.
            word = rest.lstrip()
            n = len(rest) - len(word)
            if word:
                n += len(word.split(maxsplit=1)[0])
            piece, rest = rest[:n], rest[n:]
            if len(parts) < fine:
                parts.append(piece)
                continue
            held, count = held + piece, count + 1
            if word_ends(piece.strip()) or count == most:
                parts.append(held)
                held, count = "", 0
        if held:
            parts.append(held)
        line_start += len(line)
    assert "".join(parts) == text
    sections, now = [], []
    for x in parts:
        h = digest(x.encode())
        now.append((h, len(x)))
        if h[-1] % 8 == 0 or len(now) == section:
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    return [(digest(b"".join(h for h, _ in s)), s) for s in sections]


def shared_weight(x, y):
    """Of two trees: the weight of the leaves that both have, of the larger text's."""
    a, b = ([(h[:4], n) for _, s in t for h, n in s] for t in (x, y))
    most = max(sum(n for _, n in a), sum(n for _, n in b))
    both = 0
    for leaf in a:
        if leaf in b:
            b.remove(leaf)
            both += leaf[1]
    return both / most if most else 1.0
