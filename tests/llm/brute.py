"""Plain Python statements of what the operators compute, for small fixtures."""

import hashlib
import math
import re
import statistics

from weft.llm import secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=4):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def groups(rows, percent=85, n=4):
    """doc_id -> least id reachable, over all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, n))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def links(rows, percent=85, n=4):
    """doc_id -> number of other sets that link with its own, over all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    different = set(sets.values()) - {frozenset()}
    count = {x: sum(x != y and 100 * len(x & y) >= percent * len(x | y) for y in different) for x in different}
    return {i: count.get(x, 0) for i, x in sets.items()}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in wins:
        seen[x] = seen.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(wins) if seen[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def encoding(body):
    return next((k for k, a in secret_scan.ALPHABETS.items() if set(body) <= set(a)), None)


def battery(token):
    """encoding, uniformity, runs, serial correlation, p-value of one token."""
    s = token.rstrip("=")
    name = encoding(s)
    if name is None:
        return None
    alphabet, n = secret_scan.ALPHABETS[name], len(s)
    k = len(alphabet)
    uniform = (sum(k / n * s.count(c) ** 2 for c in alphabet) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    kind = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "+"
    share = [sum(kind(c) == x for c in alphabet) / k for x in "0aA+"]
    q = 1 - sum(p * p for p in share)
    # P(first differs from second and second from third), less independence.
    covariance = sum(a * b * c for i, a in enumerate(share) for j, b in enumerate(share) for m, c in enumerate(share) if i != j != m) - q * q
    changes = sum(kind(a) != kind(b) for a, b in zip(s, s[1:], strict=False))
    runs = (changes - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * covariance)
    place = [c for c in alphabet if c.isalpha() and c not in "aeiouAEIOU"] + [c for c in alphabet if not c.isalpha()] + [c for c in alphabet if c in "aeiouAEIOU"]
    x = [place.index(c) - (k - 1) / 2 for c in s]
    serial = sum(a * b for a, b in zip(x, x[1:], strict=False)) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    a, b, c, d = secret_scan.NULLS[secret_scan.NULL_OF.get(name, name)]
    p = statistics.NormalDist().cdf((uniform - runs + 0.5 * abs(serial) - a - b * n) / (c + d * n))
    return name, uniform, runs, serial, p


def secret_spans(texts):
    """All spans of each text, the randomness battery under Benjamini-Hochberg over all texts."""
    base, tested = [base_spans(t) for t in texts], []
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", t or ""):
            body = m[0].rstrip("=")
            if len(body) >= 20 and re.search("[0-9]", body) and re.search("[A-Za-z]", body) and not any(s < m.end() and m.start() < e for s, _, e, _ in base[i]):
                b = battery(m[0])
                if b and b[1] >= -4 and abs(b[2]) <= 4 and abs(b[3]) <= 4:
                    tested.append(((b[0], min(10, int(math.log2(len(body))))), int(min(20, max(0, -math.log10(max(b[4], 1e-300)))) * 20), i, m.start(), m.end()))
    for stratum in {t[0] for t in tested}:
        own = sorted((t for t in tested if t[0] == stratum), key=lambda t: -t[1])
        least = [x[1] for x in own if 10 ** (-x[1] / 20) <= 0.05 * sum(y[1] >= x[1] for y in own) / len(own)]
        for _, b, i, s, e in own:
            if least and b >= min(least):
                base[i].append((s, 3, e, "random"))
    return [sorted(x) for x in base]
