"""Plain versions of the contracts, for small tables."""

import collections
import hashlib
import math
import re
import zlib


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def crc(i):
    return zlib.crc32(str(i).encode())


def shingles(t, n=5):
    w = words(t)
    return frozenset(tuple(w[a : a + n]) for a in range(max(len(w) - n, 0) + 1)) if w else frozenset()


def jaccard(docs, share=75):
    """{id: (set size, component)} of rows with ids; rows of one id must be equal."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, k in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * k >= share * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(docs, benchmark, window=13):
    found = collections.defaultdict(set)
    for item, t in benchmark:
        w = item_words(t)
        for a in range(max(len(w) - window, 0) + 1 if w else 0):
            found[tuple(w[a : a + window])].add(item)
    sizes = {len(x) for x in found}
    out = []
    for i, t in docs:
        w, items = item_words(t), set()
        hit = [False] * len(w)
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in found:
                    items |= found[tuple(w[a : a + n])]
                    hit[a : a + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(items), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def base_scores(docs):
    count, tokens = collections.Counter(), []
    for i, t in docs:
        held = crc(i) % 7 == 2 if i is not None else False
        tokens.append((i, held, [*words(t), "\n"]))
        if not held:
            count.update(tokens[-1][2])
    n, v = sum(count.values()), len(count)
    return [(i, held, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, held, w in tokens]


SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
]


def base_spans(t):
    spans = []
    for rank, (kind, pattern, least) in enumerate(SECRETS):
        for m in pattern.finditer(t or ""):
            if len(m.group(2) if kind == "assign" else m.group(0)) >= least:
                spans.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(spans)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def page(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def top_k(vectors, k=10, scale=1024):
    """Of rows (id, vector) that take part; rows of one id are apart."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(ok) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)
