"""Plain single-process versions of the operators, written from their contracts."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def substring_dedup(rows, size=20):
    """rows: (doc_id, text); ids distinct, no nulls."""
    first = {}
    docs = {d: words(t) for d, t in rows}
    for d in sorted(docs):
        w = docs[d]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), (d, i))
    out = {}
    for d, w in docs.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] != (d, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, n=4):
    w = words(text, True)
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def jaccard_components(rows, n=4, percent=85):
    """doc_id -> (n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, n) for d, t in rows}
    groups = {}
    for d, s in sets.items():
        for x in s:
            groups.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    seen = set()
    for members in groups.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def stupid_backoff(rows, backoff=0.4, min_count=2):
    """doc_id -> (n_words, mean log score or None); every word is known."""
    import math
    from collections import Counter

    docs = [(d, words(t, True)) for d, t in rows]
    uni = Counter(w for _, ws in docs for w in ws)
    total = sum(uni.values())
    uni[None] = sum(1 for _, ws in docs if ws)
    two = Counter(p for _, ws in docs for p in zip([None, *ws], ws))
    out = {}
    for d, ws in docs:
        logs = [math.log(two[v, w] / uni[v]) if two[v, w] >= min_count else math.log(backoff * uni[w] / total)
                for v, w in zip([None, *ws], ws)]
        out[d] = (len(ws), round(sum(logs) / len(logs), 6) if ws else None)
    return out


def personal_data(text):
    """(counts by kind, digest of kind:start:end) of the contract's base spans."""
    text = text or ""

    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    counts, spans = [], []
    for kind, pattern, ok in rules:
        found = [m for m in re.finditer(pattern, text) if ok(m.group())]
        counts.append(len(found))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def licence_places(text, phrases):
    """(n_words, {label: places of the phrase}) of the contract's words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = {}
    for phrase, label in phrases.items():
        p = phrase.split()
        found[label] = [i for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), found


def ranked_search(docs, items, top=20):
    """docs: (doc_id, text), items: (item_id, text); sorted (item_id, rank, doc_id, score)."""
    import math
    from collections import Counter

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall((t or "").translate(LOWER))
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(size for _, _, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in sorted(set((i, t or "") for i, t in items)):
        query = Counter(cut(text))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in query}
        scored = []
        for d, b, size in bags:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(c * w[t] * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in query.items() if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return out


def vector_codes(rows, rounds=6):
    """rows: (vec_id, vector, label), vectors of one length; ([(vec_id, code, error, label_error)], digest)."""
    import math

    kept = [(i, [math.floor(4096 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    d = len(kept[0][1]) // 8
    part = lambda v, p: v[p * d:(p + 1) * d]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    for _ in range(rounds):
        for p in range(8):
            own = {}
            for _, v, _ in kept:
                _, e = min((far(part(v, p), b), e) for e, b in enumerate(books[p]))
                own.setdefault(e, []).append(part(v, p))
            for e, vs in own.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    coded = []
    for i, v, c in kept:
        best = [min((far(part(v, p), b), e) for e, b in enumerate(books[p])) for p in range(8)]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(s for s, _ in best), c))
    errors = {}
    for _, _, s, c in coded:
        errors[c] = errors.get(c, 0) + s
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, s, errors[c]) for i, code, s, c in coded], digest


def entities(text):
    """{(kind, value)} of the contract's base spans, and the text with blanks in place of all matches."""
    text = text or ""
    out, masked = set(), text
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
                "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for n, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            if personal_data(m.group())[n]:
                out.add((kind, re.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()))
        masked = re.sub(pattern, lambda m: " " * len(m.group()), masked)
    return out, masked


def disclosed(rows):
    """rows: (doc_id, text); {index: {(start, end, generalise)}} of the terms that leave at most one bit of an entity open."""
    import regex

    letters = regex.compile(r"[\p{L}\p{M}]+")
    cut = lambda t: [(m.group().lower(), m.start(), m.end()) for m in letters.finditer(t)]
    there = [entities(t) for _, t in rows]
    words = [cut(t or "") for _, t in rows]
    with_term, with_entity = {}, {}
    for i, ((es, _), ws) in enumerate(zip(there, words)):
        for e in es:
            with_entity.setdefault(e, set()).add(i)
        for w, _, _ in ws:
            with_term.setdefault(w, set()).add(i)
    pairs = {}
    for i, (es, masked) in enumerate(there):
        for w in {w for w, _, _ in cut(masked)} if es else ():
            for e in es:
                pairs[e, w] = pairs.get((e, w), 0) + 1
    generalise = {}
    for (e, w), both in pairs.items():
        n_t, n_e = len(with_term[w]), len(with_entity[e])
        if 2 * both >= n_t + 1 and both * both * len(rows) >= n_e * (n_t + 1) ** 2:
            generalise[w] = max(generalise.get(w, 0), int(n_t > both))
    out = {}
    for i, (ws, (_, masked)) in enumerate(zip(words, there)):
        own = set(cut(masked))
        out[i] = {(a, b, generalise[w]) for w, a, b in ws if w in generalise and (len(with_term[w]) > 1 or (w, a, b) in own)}
    return out
