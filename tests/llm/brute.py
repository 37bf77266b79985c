"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def decontaminate(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k : k + n])].add(str(i))
    sizes = {len(k) for k in known}
    out = {}
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := known.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
    return out


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def jaccard(docs, k, percent):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, t in docs:
        w = (t or "").encode().translate(low).split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    inverted, edges = defaultdict(list), []
    for i in sorted(sets):
        common = Counter(j for e in sets[i] for j in inverted[e])
        for e in sets[i]:
            inverted[e].append(i)
        edges += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    part = components(edges, sets)
    return {i: (len(sets[i]), part[i]) for i in sets}


def substring_words(docs, length=50):
    words = {i: (t or "").encode().split() for i, t in docs}
    first, out = {}, {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - length + 1):
            k = b" ".join(w[s : s + length])
            if first.setdefault(k, i) < i:
                gone.update(range(s, s + length))
        out[i] = (len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def substring_bytes(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(dict(docs).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        end = 0
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                for j in range(max(s, end), s + length):
                    gone[j] = 1
                end = s + length
            seen.add(k)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(docs, least_chars=6, least_count=5, ratio=5, divisor=199):
    counts = Counter()
    for i, t in docs:
        for run in re.findall(r"[a-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % divisor else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    by_size, out, form = defaultdict(list), {}, {}
    for w in counts:
        by_size[len(w)].append(w)
    for w, n in counts.items():
        found = [x for d in (-1, 0, 1) for x in by_size[len(w) + d] if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
        out[w] = [n, len(found)]
    for w in out:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, *out[w], counts[form[w]] if w in form else None)
    return out


def divergence(rows, min_docs=3, top=200):
    """rows: (lang, source, text)."""
    used, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        used[lang, source].update(terms)
        held[lang].update(set(terms))
    out = {}
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        total = {s: sum(used[lang, s][t] for t in kept) for s in sources}
        whole = Counter({t: sum(used[lang, s][t] for s in sources) for t in kept})
        p = lambda n, all_: 1 + 1_000_000_000 * (n + 1) // (all_ + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            mine = {t: p(used[lang, s][t], total[s]) for t in kept}
            pairs = [(sum(f(mine[t], p(used[lang, o][t], total[o])) for t in kept), o) for o in sources if o != s]
            q = {t: p(whole[t], sum(whole.values())) for t in kept}
            terms = [(f(mine[t], q[t]), t) for t in kept if used[lang, s][t] and mine[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def drop_lines(docs, min_docs=10, min_chars=1):
    """docs: (id, text), a document by row unless both repeat. Rows of (id, lines, dropped, what is left)."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    held = Counter(k for _, t in set(docs) for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
