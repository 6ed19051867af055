"""Plain Python statements of the operators' results."""

import hashlib
import math
import re
import zlib
from collections import Counter


def sha(b):
    return hashlib.sha256(b).hexdigest()


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def decontaminated(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = word.findall(low(t or ""))
        size = min(13, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = word.findall(low(t or ""))
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if x := windows.get(tuple(w[j : j + size])):
                    found |= x
                    hit[j : j + size] = [1] * size
        names = sorted(map(str, found))
        out.append((d, len(w), sum(hit), len(names), sha(",".join(names).encode()), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def without_repeats(docs, k=50):
    first, split = {}, [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < d:
                keep[j : j + k] = [False] * k
        left = [x for x, ok in zip(w, keep) if ok]
        out.append((d, len(w), len(w) - len(left), sha(b" ".join(left))))
    return out


def near_groups(docs, k=5, percent=80):
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(d), find(e)
                up[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets]


def unigram(docs):
    """doc_id, held out, tokens, known tokens, training tokens, base score."""
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in docs]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in tokens}
    c = Counter(w for d, ws in tokens if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def natural_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def token_p(s):
    """Largest of the battery's three p-values for one token."""
    n, classes = len(s), ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in s]
    if not re.search("[a-z0-9][+/_=-]*[A-Z]|[A-Za-z][+/_=-]*[0-9]|[0-9][+/_=-]*[a-z]", s):
        return 1.0
    k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else 32 if re.fullmatch("[A-Z2-7]+=*", s) else 36 if re.fullmatch("[a-z0-9]+|[A-Z0-9]+", s) else 64
    far = n * (k * (0.1 if k == 16 else 0.066) - 1)
    chi = natural_tail((k - 1 + far - (sum(c * c for c in Counter(s).values()) * k / n - n)) / math.sqrt(2 * (k - 1 + 2 * far)))
    rate, f = (0.25 if k == 64 else 0.1), max(1e-9, min(1 - 1e-9, sum(a != b for a, b in zip(classes, classes[1:])) / (n - 1)))
    runs = 1.0 if f <= rate else math.exp(-(n - 1) * (f * math.log(f / rate) + (1 - f) * math.log((1 - f) / (1 - rate))))
    dev = [ord(c) - sum(map(ord, s)) / n for c in s]
    r = min(0.999, abs(sum(a * b for a, b in zip(dev, dev[1:])) / max(1e-9, sum(d * d for d in dev))))
    return max(chi, runs, natural_tail((math.atanh(0.8) - math.atanh(r)) * math.sqrt(n - 3)))


def all_spans(text):
    """Base spans and random ones."""
    t, base = text or "", [x.split(":") for x in base_spans(text).split(",") if x]
    hidden = list(t.replace("\x01", "\x02"))
    for _, a, b in base:
        hidden[int(a) : int(b)] = "\x01" * (int(b) - int(a))
    tokens = [m for m in re.finditer("[A-Za-z0-9+/_=\x01-]+", "".join(hidden)) if m.end() - m.start() >= 12 and "\x01" not in m[0]]
    tested = sorted((token_p(m[0]), m.start(), m.end()) for m in tokens)
    passing = [p for i, (p, _, _) in enumerate(tested, 1) if p <= 0.01 * i / len(tested)]
    spans = [(int(a), ("assign", "access", "hex").index(k), int(b)) for k, a, b in base] + [(a, 3, b) for p, a, b in tested if passing and p <= max(passing)]
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in sorted(spans))
