"""Plain versions of the learned and ordered operators: byte contexts, fair queues, shards, decision lists."""

import hashlib
import math
from collections import Counter, defaultdict


def code_length(train, text, order=3):
    """Bits of ``text`` by prediction by partial matching, method C, over the texts ``train``."""
    pad = " " * order
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        b = (pad + t.lower()).encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[k][b[i - k : i]][b[i]] += 1
    b, bits = (pad + text.lower()).encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = seen[k].get(b[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                bits -= math.log2(c[b[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def targets(sizes, most=3, weights=(5, 2, 1)):
    """sizes by source -> target: shares of all sizes by repeating weights, none above ``most`` times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def fair_queue(docs, seed="mix", most=3):
    """docs: (id, source, size), ids unique; returns id -> copies: documents by virtual finish time up to the budget."""
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    target, queue = targets(size, most), defaultdict(list)
    for i, s, n in docs:
        queue[s].append((hashlib.md5(f"{'null' if i is None else i}{seed}".encode()).hexdigest(), n, i))
    items = []
    for s, rows in queue.items():
        total = 0
        for h, n, i in sorted(rows):
            total += n
            if n and target[s]:
                items += [((e * size[s] + total) / target[s], s is None, s or "", h, e, n, i) for e in range(most)]
    out, spent, budget = Counter(), 0, sum(size.values())
    for *_, n, i in sorted(items):
        spent += n
        if spent > budget:
            break
        out[i] += 1
    return out


def shards(records, count, slack=0.02):
    """records: (group key, id, size); returns their shards: large groups placed one by one, the others cut in order."""
    total = sum(n for *_, n in records)
    fair = max(1.0, total / count)
    groups = defaultdict(list)
    for k, (g, i, n) in enumerate(records):
        groups[g].append((i, k, n))
    sizes = {g: sum(n for *_, n in rows) for g, rows in groups.items()}
    large = [g for g in groups if sizes[g] > slack * fair]
    load, out = [0.0] * count, {}
    for g in sorted(large, key=lambda g: (-sizes[g], g)):
        ends, at = [], 0.0
        while at < sizes[g]:
            s = load.index(min(load))
            room = fair - load[s]
            left = sizes[g] - at
            part = left if len(groups[g]) == 1 or left <= room + slack * fair or room <= slack * fair else room
            at, load[s] = at + part, load[s] + part
            ends.append((at, s))
        ends[-1] = (float("inf"), ends[-1][1])
        run = 0
        for _, k, n in sorted(groups[g]):
            run += n
            out[k] = next(s for end, s in ends if end > run - n / 2)
    room = [max(0.0, fair - x) for x in load]
    scale = (total - sum(sizes[g] for g in large)) / max(1.0, sum(room))
    run = 0
    for g in sorted(set(groups) - set(large)):
        run += sizes[g]
        s = sum(sum(room[: i + 1]) * scale <= run - sizes[g] / 2 for i in range(count - 1))
        out |= {k: s for _, k, _ in groups[g]}
    return [out[k] for k in range(len(records))]


def covering(rows, features, bounds=12, max_literals=3, max_rules=6, least_cover=8, least_precision=0.8):
    """rows: (values by feature, target, whether it grows rules); returns the rules as lists of literals, and the default."""
    good, bad = (sum(t is v for _, t, _ in rows) for v in (True, False))
    if not good or not bad:
        return [], bad == 0
    aim = good < bad
    literals = []
    for f in features:
        cuts = set()
        for v in (True, False):
            xs = sorted(x[f] for x, t, _ in rows if t is v)
            cuts |= {xs[max(0, math.ceil(i / (bounds + 1) * len(xs)) - 1)] for i in range(1, bounds + 1)}
        literals += [(f, above, b) for b in sorted(cuts) for above in (True, False)]
    holds = lambda x, rule: all((x[f] > b) == above for f, above, b in rule)
    count = lambda part, rule: tuple(sum((t is aim) == hit for x, t, _ in part if holds(x, rule)) for hit in (True, False))
    info = lambda p, n: math.log2(p / (p + n))
    rules, left = [], list(rows)
    while len(rules) < max_rules:
        grow, prune = [r for r in left if r[2]], [r for r in left if not r[2]]
        chosen, (p0, n0) = [], count([r for r in left if r[2]], [])
        while len(chosen) < max_literals and p0 and n0:
            best, gain = None, 1e-9
            for lit in literals:
                p, n = count(grow, [*chosen, lit])
                if p >= least_cover and p * (info(p, n) - info(p0, n0)) > gain:
                    best, gain, found = lit, p * (info(p, n) - info(p0, n0)), (p, n)
            if best is None:
                break
            chosen, (p0, n0) = [*chosen, best], found
        if not chosen:
            break
        worth = lambda k: (lambda c: (c[0] + 1) / (sum(c) + 2))(count(prune, chosen[:k]))
        k = max(range(1, len(chosen) + 1), key=lambda k: (worth(k), -k))
        p, n = count(left, chosen[:k])
        if p < least_cover or p / (p + n) < least_precision:
            break
        rules.append(chosen[:k])
        left = [r for r in left if not holds(r[0], chosen[:k])]
    return rules, not aim
