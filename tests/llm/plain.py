"""Plain Python versions of the operators, for small tables."""

import math
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Null, empty, blank, short, long, repeated lines and words, symbols, astral characters.
ODD_TEXTS = [
    None, "", " \n\t ", "one", "a b c d", "word " * 70, "It's we'll 12345 ½ Ⅷ x​y \U0001F600 l'été n’est", "a\x00b\x85c d　e",
    "\n".join(["the same line of seven words here", "another line that has some words too"] * 3), "日本語のテキスト" * 40, "x" * 3000, " " * 2500 + "\n" * 400,
    "tail | of | a | table ### %%% &&& *** $$$ !! " * 30, "Long text of many different words " + " ".join(f"w{i}" for i in range(6000)),
]


def words(text):
    return WORD.findall(text or "")


def measures(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), copies, len(covered)


def estimate(patterns, n_rules, steps, smooth):
    """Log likelihood ratios by expectation-maximisation; patterns: Counter of vote tuples (-1, 0, 1)."""
    posterior = {p: 0.1 if -1 in p else 0.9 for p in patterns}
    for _ in range(steps):
        total, good = sum(patterns.values()), sum(n * posterior[p] for p, n in patterns.items())
        ratio = {}
        for r in range(n_rules):
            for v in (-1, 0, 1):
                g = sum(n * posterior[p] for p, n in patterns.items() if p[r] == v)
                b = sum(n * (1 - posterior[p]) for p, n in patterns.items() if p[r] == v)
                ratio[r, v] = math.log((g + smooth) / (good + 3 * smooth)) - math.log((b + smooth) / (total - good + 3 * smooth))
        prior = math.log((good + smooth) / (total - good + smooth))
        posterior = {p: 1 / (1 + math.exp(-prior - sum(ratio[r, v] for r, v in enumerate(p)))) for p in patterns}
    return posterior


def shingles(text, width=5):
    w = words(text)
    return Counter(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def near_classes(docs, least=0.8):
    """{doc_id: least id of its component}, comparing all pairs."""
    parent = {d: d for d, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in docs]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and sum((x & y).values()) >= least * sum((x | y).values()):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {d: top(d) for d, _ in docs}


def edits(a, b):
    """Levenshtein distance of two lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_lines(docs, least_words=5):
    """[(doc_id, text without repeated lines and those near an earlier kept one, dropped)]; docs in any order."""
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        for i, line in enumerate(t.split("\n")):
            w = tuple(words(line))
            if w:
                first.setdefault(w, (d, i))
    near, kept = set(), {}
    for w in sorted((w for w in first if len(w) >= least_words), key=first.get):
        if any(edits(v, w) == 1 for n in (len(w) - 1, len(w), len(w) + 1) for v in kept.get(n, ())):
            near.add(w)
        else:
            kept.setdefault(len(w), []).append(w)
    out = []
    for d, t in docs:
        if d is None or t is None:
            out.append((d, t, 0))
            continue
        lines = t.split("\n")
        keep = [x for i, x in enumerate(lines) if not words(x) or (tuple(words(x)) not in near and first[tuple(words(x))] == (d, i))]
        out.append((d, "\n".join(keep), len(lines) - len(keep)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target}: shares by weight, the excess over the limit dealt out again until none is left."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out
