"""Plain-Python versions of the operators, straight from their contracts."""

import hashlib
import re

LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    t, out = text or "", []
    for k, (p, group, least) in enumerate(((r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[group]) >= least]
    names = ("assign", "access", "hex")
    return [f"{names[k]}:{a}:{b}" for a, k, b in sorted(out)]


def luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text):
    t, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for name, p, good in checks:
        out += [f"{name}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if good(m[0])]
    return out


def shingle_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def near(rows, k, percent):
    """rows: (doc_id, text). {doc_id: (size, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = shingle_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = leak_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add("" if i is None else str(i))
    sizes = sorted({len(w) for w in wins})
    out = []
    for i, t in docs:
        w = leak_words(t)
        hit, named = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if got := wins.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    named |= got
        out.append((i, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return out
