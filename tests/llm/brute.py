"""Plain versions of the text operators, straight from their contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def removed_spans(texts, n=200):
    """Maximal removed runs of each text."""
    starts = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for d, t in enumerate(data):
        for p in range(len(t) - n + 1):
            starts[t[p : p + n]].append((d, p))
    covered = [bytearray(len(t)) for t in data]
    for places in starts.values():
        if len(places) > 1:
            for d, p in places:
                covered[d][p : p + n] = b"\x01" * n
    out = []
    for t, c in zip(data, covered, strict=True):
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(c))]
        kept = bytes(b for b, gone in zip(t, c, strict=True) if not gone)
        out.append((len(t), sum(c), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(ids, fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min(least[find(i)]) for i in range(len(ids))]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text or ""):
            n = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= n <= 19 and luhn(m[0])):
                continue
            if kind == "phone" and not 9 <= n <= 15:
                continue
            out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


def told(spans):
    return ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e, _ in spans)


def base_counts(text):
    text = text or ""
    w = SPLIT.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def tokens(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def plain_words(text):
    return [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in (text or "").split()) if x]


def leaks(text, item, k=5, least=0.8):
    """Best weighted similarity of an item-sized window of the text."""
    a, b = plain_words(text), plain_words(item)
    k = min(k, len(b))
    if not b or len(a) < k:
        return 0.0
    x, y = ([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in (a, b))
    own, best = Counter(y), 0.0
    width = min(len(x), len(y))
    for s in range(len(x) - width + 1):
        c = Counter(x[s : s + width])
        both = sum((c & own).values())
        best = max(best, both / (sum(c.values()) + len(y) - both))
    return best


def shingle_set(text, k):
    w = SPLIT.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def language_scores(labelled, text, n=4, floor=2e-6, relative=0.05):
    """The share of the text's n-grams that each language holds, by plain sets of members; None without a letter."""

    def grams(t):
        low = (t or "").lower().encode()
        w = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in low).split()
        t = (b" " + b"".join(x + b" " for x in w)).ljust(n)
        return [t[i : i + n] for i in range(len(t) - n + 1)]

    key = tuple(labelled)
    if key not in _MEMBERS:
        counts = defaultdict(Counter)
        for t, lang in labelled:
            counts[lang].update(grams(t))
        share = {lang: {g: k / c.total() for g, k in c.items()} for lang, c in counts.items()}
        most = Counter()
        for s in share.values():
            for g, x in s.items():
                most[g] = max(most[g], x)
        _MEMBERS[key] = {lang: {g for g, x in s.items() if x >= floor and x >= relative * most[g]} for lang, s in share.items()}
    if not any(c.isalpha() for c in text or ""):
        return None
    own = grams(text)
    return {lang: sum(g in held for g in own) / len(own) for lang, held in _MEMBERS[key].items()}


_MEMBERS: dict = {}


def preference_weights(x, y, pairs, reg):
    """Bradley-Terry weights by Newton's method: x and y are the features of the two labels, pairs their places and which comes first."""
    d = np.array([(x[g] - y[b]) * (1 if first else -1) for first, g, b in pairs])
    label = np.array([first for first, _, _ in pairs], float)
    std = d.std(0, ddof=1)
    used = std > 0
    z = d[:, used] / std[used]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (p - label) / len(z) + reg * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + reg * np.eye(len(w)), grad)
    out = np.zeros(d.shape[1])
    out[used] = w / std[used]
    return out


def fertility_verdicts(rows, encoders, width=5.0, group=30):
    """kept of each (doc_id, lang, text), by plain loops over bands; encoders give a word's (token, is byte) list."""
    told = []
    for d, lang, t in rows:
        words = SPLIT.findall(t or "")
        measures = []
        for encode in encoders:
            tokens = [x for w in words for x in encode(w)]
            n = len(tokens)
            p = np.array(list(Counter(x for x, _ in tokens).values())) / max(n, 1)
            h = float(-(p * np.log2(p)).sum())
            measures += [sum(map(len, words)) / n, sum(b for _, b in tokens) / n, h / np.log2(n) if n > 1 else 1.0] if n else [None] * 3
            if encode is encoders[0]:
                octave = int(np.floor(2 * np.log2(max(n, 1))))
        c = base_counts(t)
        told.append((d, lang or "", t or "", octave, measures, c[0] < 50 or 100 * c[4] > 50 * c[0], c[0] >= 50))
    texts = {(lang, o, t): m for _, lang, t, o, m, _, judged in told if judged}
    floors = (0.08, 0.02, 0.03) * len(encoders)

    def band(lang, o):
        for same in (True, False):
            at = [(abs(k[1] - o), m) for k, m in texts.items() if k[0] == lang or not same]
            for reach in sorted({a for a, _ in at}):
                near = [m for a, m in at if a <= reach]
                if len(near) >= group:
                    return near
        return list(texts.values())

    def quartile(values, share):
        return sorted(values)[max(int(np.ceil(share * len(values))) - 1, 0)]

    out = []
    for d, lang, _, o, m, failed, _ in told:
        near = band(lang, o)
        inside = bool(near) and m[0] is not None
        for i, least in enumerate(floors):
            if inside:
                lo, mid, hi = (quartile([x[i] for x in near], q) for q in (0.25, 0.5, 0.75))
                inside = abs(m[i] - mid) <= max(least, width * (hi - lo) / 2)
        out.append((d, not failed and inside))
    return out
