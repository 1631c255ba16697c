"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def utf8(text):
    return (text or "").encode()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, covered, first = {}, set(), {}
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in first:
            covered |= {*range(i, i + 5), *range(first[g], first[g] + 5)}
        else:
            first[g] = i
    del seen
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_groups(docs):
    """docs: (id, text); returns id -> (set size, smallest id reachable), ids unique and not null."""
    sets = {i: shingles(t) for i, t in docs}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = roots(sets, links)
    return {i: (len(s), low[i]) for i, s in sets.items()}


def secret_spans(text, rules):
    out = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, m.end(), r.kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def repeats(docs, window=20):
    """docs: (id, text) by ascending id; returns id -> (n_words, n_removed, sha256)."""
    seen, out = {}, {}
    for i, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if tuple(w[s : s + window]) in seen:
                gone |= set(range(s, s + window))
            seen.setdefault(tuple(w[s : s + window]), (i, s))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def vector_groups(rows, least=0.93):
    import numpy as np

    ok = [(i, np.array(x, dtype=float), y) for i, x, y in rows if i is not None and y is not None and x and all(e is not None and math.isfinite(e) for e in x) and any(x)]
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt(a[1] @ a[1]) / math.sqrt(b[1] @ b[1]) >= least]
    low = roots([i for i, *_ in rows], links)
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], low[i], low[i] == i) for i in n}


def crc(text):
    return zlib.crc32(utf8(text))


def periodic_runs(w, least=6, times=4):
    """Runs (start, length, period) by start, then period."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            b = i + q
            if b - a >= max(least, times * q) and not any(x <= a and b <= x + m and q % p == 0 for x, m, p in out):
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted_words(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label), ids unique; returns {id: (code, error, label_error)} and the digest of the codebooks."""
    ok = sorted((i, [math.floor(256 * e) for e in x], y) for i, x, y in rows if x and all(e is not None and math.isfinite(e) for e in x))
    if not ok:
        return {}, None
    wide = len(ok[0][1]) // parts
    cut = lambda x: [tuple(x[p * wide : (p + 1) * wide]) for p in range(parts)]
    vectors = [cut(x) for _, x, _ in ok]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in vectors:
                got.setdefault(near(books[p], v[p])[1], []).append(v[p])
            for k, xs in got.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, by_label = {}, {}
    for (i, _, y), v in zip(ok, vectors):
        found = [near(books[p], v[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y)
        by_label[y] = by_label.get(y, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (c, e, by_label[y]) for i, (c, e, y) in out.items()}, digest


def warc_facts(pages):
    """pages: (id, html), ids unique; returns id -> (bytes, digest, type, refers_to)."""
    first = {}
    for i, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = {}
    for i, h in pages:
        b, low = utf8(h), first.get(h or "")
        again = len(b) >= 100 and low is not None and low != i
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None)
    return out
