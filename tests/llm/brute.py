"""Plain versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(UP))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def base(text):
    text = text or ""
    w, seen = words(text), defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    covered = {k + i for at in seen.values() if len(at) > 1 for k in at for i in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def failed(text):
    n, _, _, _, rep = base(text)
    return n < 20 or 100 * rep > 30 * n


def line_key(line):
    return tuple(words(line.translate(UP)))


def quality(docs, limit, share, depleted, left):
    """docs: (doc_id, text, source). (kept, text) per row."""
    copies = Counter((s, t) for _, t, s in docs)
    lines = {}  # per text of a host: line -> first place, words
    for s, t in copies:
        lines[s, t] = own = {}
        for k, x in enumerate(y for y in (t or "").split("\n") if line_key(y)):
            at, n = own.get(line_key(x), (k, 0))
            own[line_key(x)] = at, n + len(line_key(x))
    by_docs, held = Counter(), Counter()
    for (s, t), own in lines.items():
        for key in own:
            by_docs[s, key] += copies[s, t]
            held[s, key] += 1
    every, texts = Counter(s for _, _, s in docs), Counter(s for s, _ in copies)
    some = {k for k, n in by_docs.items() if n > limit and n > share * every[k[0]]}
    units = defaultdict(set)
    for (s, t), own in lines.items():
        mine = {k: v for k, v in own.items() if (s, k) in some}
        most = 2 * sum(n for _, n in mine.values()) > sum(n for _, n in own.values())
        one = min(mine, key=lambda k: (held[s, k], mine[k][0])) if most else t
        for k in mine:
            units[s, k].add((most, one))
    often = {k for k, v in units.items() if len(v) > limit and len(v) > share * texts[k[0]]}
    out = []
    for _, t, s in docs:
        n = len(words(t))
        gone = sum(len(line_key(x)) for x in (t or "").split("\n") if (s, line_key(x)) in often) / n if n else 0
        kept = not failed(t) and not (gone > depleted or gone and round(n * (1 - gone)) < left)
        out.append((kept, "\n".join(x for x in t.split("\n") if (s, line_key(x)) not in often) if t and gone else t))
    return out


def components(docs):
    """(n_shingles, component) per (doc_id, text)."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where, met = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for at in where.values():
        met.update((a, b) for i, b in enumerate(at) for a in at[:i])
    for (a, b), c in met.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)].append(i)
    return [(len(s), min(least[find(k)], default=None) if s else docs[k][0]) for k, s in enumerate(sets)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text):
    w = tokens(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def leaks(docs, items):
    own = [(i, grams(t)) for i, t in items]
    out = set()
    for d, t in docs:
        s = grams(t)
        out |= {(d, i, len(g), len(s & g)) for i, g in own if g and 4 * len(s & g) >= 3 * len(g)}
    return out


ASSIGN = re.compile("(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def secrets(text):
    return sorted((m.start(), k, m.end(), n) for k, (n, r, g, least) in enumerate(KINDS) for m in r.finditer(text or "") if len(m.group(g)) >= least)


def redact(text, spans):
    out, pos = "", 0
    for s, e in spans:
        if s >= pos:
            out += text[pos:s] + "[SECRET]"
        pos = max(pos, e)
    return out + text[pos:]


def mix(docs):
    """docs: (doc_id, text, source). (doc_id, size, source_size, target, taken by pass) per row."""
    size = [len(words(t)) for _, t, _ in docs]
    order = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(z for z, d in zip(size, docs, strict=True) if d[2] == s) for s in order}
    target, free, left = {}, set(order), 1.5 * sum(size)
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: level * w[s] for s in free}
    out = [None] * len(docs)
    for s in order:
        rows = sorted((hashlib.md5(f"{'' if d[0] is None else d[0]}:{d[1] or ''}".encode()).hexdigest(), k) for k, d in enumerate(docs) if d[2] == s)
        at, whole = 0, int(target[s] + 0.5)
        for _, k in rows:
            take = [max(0, min(size[k], whole - x)) for x in (at, at + total[s])]
            out[k] = (docs[k][0], size[k], total[s], target[s], *take)
            at += size[k]
    return out
