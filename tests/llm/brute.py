"""Plain Python versions of the corpus queries, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def mixing_targets(totals: dict) -> dict:
    """Target words by source, filled like connected vessels."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(totals.values()), set()
    while True:
        left = budget - sum(2 * totals[s] for s in full)
        scale = sum(weight[s] for s in order if s not in full)
        aims = {s: 2 * totals[s] if s in full else left * weight[s] / scale for s in order}
        more = {s for s in order if s not in full and aims[s] > 2 * totals[s]}
        if not more:
            return aims
        full |= more


def spans(text, kinds):
    """(counts, digest) of spans [(kind, pattern, keep)] in a text."""
    text, found, counts = text or "", [], Counter()
    for rank, (kind, pattern, keep) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if keep(m):
                found.append((m.start(), rank, kind, m.end()))
                counts[kind] += 1
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    return counts, joined, hashlib.sha256(joined.encode()).hexdigest()


SECRET_KINDS = [
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 6,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def luhn(text):
    digits = [int(c) for c in text if c in "0123456789"]
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


PII_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c in "0123456789" for c in m[0]) <= 15),
]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(found, found[1:], found[2:]))
    inside = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    n, r = len(found), len(inside)
    return (
        n,
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        r,
        n < 50 or 100 * r > 50 * n,
    )


def passes(text):
    """Whether a text passes all rules of quality."""
    n, chars, symbols, dup, _, failed = quality(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    return not failed and symbols <= n * 0.5 and 2 <= chars / max(n, 1) <= 15 and 100 * dup <= 50 * lines


def fingerprint(text):
    found = words((text or "").translate(LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=2):
    """Smallest id reachable for each row, by comparing all pairs."""
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(ids))]


def near_groups(texts, shingle):
    """A function of a similarity that gives groups of texts linked by that share of their shingles, by comparing all pairs."""
    sets = []
    for t in texts:
        found = words((t or "").translate(LOWER))
        sets.append({tuple(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))})
    alike = [[len(a & b) / len(a | b) for b in sets[:i]] for i, a in enumerate(sets)]

    def groups(least):
        up = list(range(len(sets)))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, row in enumerate(alike):
            for j, x in enumerate(row):
                if x >= least:
                    up[top(i)] = top(j)
        found = {}
        for i in range(len(sets)):
            found.setdefault(top(i), []).append(i)
        return list(found.values())

    return groups


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]
