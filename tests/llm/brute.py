"""Straight-line versions of the operators' contracts, one document or one pair at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def words(s):
    return re.findall("[^ \t-\r]+", s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(SPACE))
    held = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[lower(text or "")].append(doc)
    return {d: (max(g), len(g), d == max(g), sha(t)) for t, g in groups.items() for d in g}


def pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def near_links(docs, least=0.8, k=5):
    """Pairs of different word sequences whose labelled shingles in common order reach the similarity."""
    seqs = {}
    for doc, text in docs:
        w = words(lower(text or ""))
        if w:
            n, c = min(k, len(w)), Counter()
            own = []
            for i in range(len(w) - n + 1):
                s = tuple(w[i : i + n])
                own.append((s, c[s]))
                c[s] += 1
            seqs[doc] = own
    ids = sorted(seqs)
    sets = {d: set(s) for d, s in seqs.items()}
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n, m = len(seqs[a]), len(seqs[b])
            if min(n, m) < least * max(n, m) or len(sets[a] & sets[b]) < least / (1 + least) * (n + m) - 1e-9:
                continue
            at = {s: i for i, s in enumerate(seqs[b])}
            best = [0] * (m + 1)  # plain quadratic common subsequence
            for s in seqs[a]:
                new, j = best[:], at.get(s)
                for i in range(m):
                    new[i + 1] = max(new[i], best[i + 1], best[i] + 1 if i == j else 0)
                best = new
            if best[m] / (n + m - best[m]) >= least:
                out.add((a, b))
    return out


def classes(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    groups = defaultdict(list)
    for i in ids:
        groups[root(i)].append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 10 == 0


def base_scores(docs):
    import math

    tokens = {d: [*words(lower(t or "")), " "] for d, t in docs}
    c = Counter(w for d, t in tokens.items() if not held_out(d) for w in t)
    n, v = sum(c.values()), len(c)
    return {d: (held_out(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for d, t in tokens.items()}
