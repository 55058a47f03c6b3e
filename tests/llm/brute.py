"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def one_per_id(docs):
    """{doc_id: largest text} of the rows with an id."""
    out = {}
    for doc_id, text in docs:
        if doc_id is not None:
            out[doc_id] = max(out.get(doc_id, ""), text or "")
    return out


def substring(docs, window=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    docs = {k: words(v) for k, v in one_per_id(docs).items()}
    seen, out = set(), {}
    for doc_id in sorted(docs):
        w, gone = docs[doc_id], set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near(docs, k=5):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for doc_id, text in one_per_id(docs).items():
        w = WORD.findall(lower(text))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def benchmark_hits(docs, items, window=10):
    """Per row of docs: (doc_id, hit word positions, item ids)."""
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(window, len(w))
        if item is not None and n:
            for i in range(len(w) - n + 1):
                wins[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc_id, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc_id, len(w), hit, sorted(found)))
    return out


def cut_benchmark(text, hit):
    """The text without its hit words; the pieces around each removed run joined by a space."""
    spans = [m.span() for m in ALNUM.finditer(lower(text))]
    runs = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    pieces, at = [], 0
    for a, b in runs:
        pieces.append(text[at : spans[a][0]].strip(" "))
        at = spans[b][1]
    pieces.append(text[at:].strip(" "))
    return " ".join(p for p in pieces if p)


def patience(a, b):
    """Matched pairs of positions: common ends, then unique common items, then between them."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    ca, cb = Counter(a), Counter(b)
    both = [(a.index(x), j) for j, x in enumerate(b) if ca[x] == 1 and cb[x] == 1]
    if not both:
        return []
    # longest increasing run; of equal ones, the one through the latest items of each length
    size = []
    for n, (i, _) in enumerate(both):
        size.append(1 + max((size[m] for m in range(n) if both[m][0] < i), default=0))
    chain, n = [], len(both)
    for length in range(max(size), 0, -1):
        n = max(m for m in range(n) if size[m] == length)
        chain.insert(0, both[n])
    out, x, y = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(p + x, q + y) for p, q in patience(a[x:i], b[y:j])]
        if i < len(a) or j < len(b):
            out.append((i, j))
        x, y = i + 1, j + 1
    return out


def line_dedup(docs, anchor=8, block=12, most=None):
    """{doc_id: (text without repeated blocks, removed lines)}; with ``most``, lines of fewer than
    ``block`` words that more documents hold stay in their first holder only."""
    texts = one_per_id(docs)
    lines = {d: t.split("\n") for d, t in texts.items()}
    keys = {d: [" ".join(words(s)) for s in x] for d, x in lines.items()}
    holder = {}
    for d in sorted(keys):
        for k in keys[d]:
            if len(words(k)) >= anchor:
                holder.setdefault(k, d)
    holders = defaultdict(set)
    for d in keys:
        for k in keys[d]:
            if 0 < len(words(k)) < block:
                holders[k].add(d)
    out = {}
    for d in keys:
        gone = {n for n, k in enumerate(keys[d]) if most is not None and len(holders.get(k, ())) > most and min(holders[k]) != d}
        for e in {holder[k] for k in keys[d] if holder.get(k, d) != d}:
            runs = []
            for i, j in patience(keys[e], keys[d]):
                if runs and runs[-1][-1] == (i - 1, j - 1):
                    runs[-1].append((i, j))
                else:
                    runs.append([(i, j)])
            for run in runs:
                if sum(len(words(keys[d][j])) for _, j in run) >= block:
                    gone.update(j for _, j in run)
        out[d] = ("\n".join(s for n, s in enumerate(lines[d]) if n not in gone), len(gone))
    return out


def mix(docs, weights, share=0.6, epochs=2, seed=11):
    """Sorted (doc_id, epoch) of docs (doc_id, text, lang, source)."""
    rows = [((("family-" + (s or "")[-1:]), lang or "", s or ""), len(words(t)), "" if d is None else str(d), d)
            for d, t, lang, s in docs]
    tokens = Counter()
    for leaf, n, _, _ in rows:
        tokens[leaf] += n

    def fill(total, children):
        """Budgets of {name: (room, weight)}, by raising one line until the total is used up."""
        if sum(r for r, _ in children.values()) <= total:
            return {k: float(r) for k, (r, _) in children.items()}
        left, open_, out = float(total), dict(children), {}
        while open_:
            line = left / sum(w for _, w in open_.values())
            full = {k: r for k, (r, w) in open_.items() if r <= line * w}
            if not full:
                return out | {k: line * w for k, (_, w) in open_.items()}
            for k, r in full.items():
                out[k] = float(r)
                left -= r
                del open_[k]
        return out

    def budget(prefix, total):
        depth = len(prefix)
        if depth == 3:
            return {prefix: total}
        names = {leaf[depth] for leaf in tokens if leaf[:depth] == prefix}
        room = {n: (epochs * sum(t for leaf, t in tokens.items() if leaf[: depth + 1] == (*prefix, n)),
                    weights.get(n, 1.0) if depth == 1 else 1.0) for n in names}
        out = {}
        for n, b in fill(total, room).items():
            out |= budget((*prefix, n), b)
        return out

    out = []
    for leaf, b in budget((), int(sum(tokens.values()) * share + 1e-9)).items():
        b, total = int(b + 1e-6), tokens[leaf]
        whole, rest = divmod(b, total) if total else (0, 0)
        mine = [(hashlib.md5(f"{seed}:{whole}:{s}".encode()).hexdigest(), n, d) for lf, n, s, d in rows if lf == leaf]
        for key, _, d in mine:
            run = sum(n for k, n, _ in mine if k <= key)
            copies = whole + (1 if run <= rest and whole < epochs else 0)
            out += [(d, e) for e in range(copies)]
    return sorted(out, key=str)
