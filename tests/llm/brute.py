"""Plain versions of the contracts, for small inputs."""

import hashlib
import re

UP = {c: c + 32 for c in range(65, 91)}
WORD1 = re.compile("[^\x20\x09-\x0d]+")
WORD2 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def near_copies(docs, size=2, percent=80):
    sets = {}
    for d, t in docs:
        w = WORD1.findall((t or "").translate(UP))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sorted(sets) if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def contamination(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = WORD2.findall((t or "").translate(UP))
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w = WORD2.findall((t or "").translate(UP))
        hit, whose = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    whose |= own
        out[d] = (len(w), len(hit), len(whose), hashlib.sha256(",".join(sorted(whose)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def mix_targets(sizes, weights=(3, 1, 2), share=1.5):
    """sizes: {source: words}; by code point, None last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest, out = share * sum(sizes.values()), set(order), {}
    while rest:
        total = sum(w[s] for s in rest)
        full = {s for s in rest if left * w[s] / total > 2 * sizes[s]}
        if not full:
            out |= {s: left * w[s] / total for s in rest}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        rest -= full
    return out


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judge(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        host, path = re.match("([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate(UP)
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def secrets(text):
    t, spans = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, p, n) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)), 1):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if len(m[0]) >= n]
    return [x[2] for x in sorted(spans)]


def repeats(docs, size=400):
    """docs: [(id, text)]. Per place in docs: bytes, removed, spans, kept bytes."""
    raw = [(t or "").encode() for _, t in docs]
    seen = {}
    for b in raw:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                cover[i : i + size] = b"\1" * size
        kept = bytes(c for c, k in zip(b, cover, strict=True) if not k)
        out.append((d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out
