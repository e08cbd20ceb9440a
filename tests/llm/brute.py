"""Plain Python versions of the contracts."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD7 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def base_quality(text):
    t = text or ""
    w = WORD.findall(t)
    seen, hit = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": len(w) < 10 or 100 * len(hit) > 20 * len(w),
    }


def base_secrets(text):
    t = text or ""
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key")
    assign = re.compile(f"""({names})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    out = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
    return {"n_assign": len(a), "n_access": len(b), "n_hex": len(c), "base_sha256": hashlib.sha256(out.encode()).hexdigest()}


def shingles(text):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """{id: (n_shingles, component)} for {id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(texts, items):
    """{row: dict} for {row: text} and [(item, text)]."""
    windows = {}
    for i, t in items:
        w = WORD7.findall(low(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    lengths, out = {len(x) for x in windows}, {}
    for r, t in texts.items():
        w, hit, found = WORD7.findall(low(t or "")), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[r] = {"n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), "contaminated": bool(hit)}
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} for {source: size}: what is over the caps is dealt again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, dict(sizes)
    total = share * sum(sizes.values())
    while left:
        level = (total - sum(full.values())) / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > cap * left[s]]
        if not over:
            return full | {s: level * w[s] for s in left}
        for s in over:
            full[s] = cap * left.pop(s)
    return full
