"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def jaccard_components(rows, percent=75):
    """{doc_id: (set size, least id reachable)} for (doc_id, text) rows, by counting overlaps over inverted lists."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    first = {}
    for i, s in sets:
        if s:
            join(i, first.setdefault(s, i))
    lists, size = defaultdict(list), {}
    for s, i in first.items():
        met = Counter(j for x in s for j in lists[x])
        for j, c in met.items():
            if 100 * c >= percent * (len(s) + size[j] - c):
                join(i, j)
        size[i] = len(s)
        for x in s:
            lists[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(texts, length=400):
    """For each text (bytes): maximal ranges covered by ``length``-byte strings that start elsewhere too."""
    seen = Counter()
    for t in texts:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def area_under_curve(pairs):
    """Of (score, label) rows: the share of pairs of a 1 and a 0 that the score orders rightly."""
    pairs = sorted(pairs)
    ones = sum(y for _, y in pairs)
    zeros = len(pairs) - ones
    below = won = i = 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        one = sum(y for _, y in pairs[i:j])
        zero = j - i - one
        won += one * (below + zero / 2)
        below += zero
        i = j
    return won / (ones * zeros)


def hard_negatives(rows, anchors, low=80, positives=5, negatives=5):
    """Sorted (anchor, positive, rank, negative, positive score, negative score) of (id, label, integer vector) rows."""
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lb) for i, lb, v in rows if i != a)
        for s, p, _ in [t for t in scored if t[2] == la][:positives]:
            good = [t for t in scored if t[2] != la and low * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -sn) for k, (sn, n, _) in enumerate(good)]
    return sorted(out)


PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")


def collocations(rows, least=10, top=2000):
    """{lang: [(phrase, a, l, r, n, score)]} of (lang, text) rows."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in PIECES.split((text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        longer = Counter()
        for p, c in f.items():
            if len(p) == 3 and c >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], c)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((" ".join(p), a, l, r, n, score))
        out[lang] = sorted(found, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]
    return {k: v for k, v in out.items() if v}


SECRETS = (("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
                                 r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
           ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def secrets(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p, g, least) in enumerate(SECRETS)
             for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(k, s, e) for s, _, k, e in sorted(found)]
