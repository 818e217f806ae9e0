"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import re
from math import log10

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text, w = text or "", words(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _xx(*values):
    """Chained 64-bit hashes with seed 42, of strings or longs."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return _signed(seed)


def buckets(text, n):
    h = [_xx(w) for w in words(text)]
    return [x % n for x in h] + [_xx(a, b) % n for a, b in zip(h, h[1:])]


def shingle_set(text):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def near_duplicates(docs, percent=85):
    """{id: (n_shingles, component, kept)} by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def base_scores(docs, held):
    """{id: (n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {d: [*words((t or "").translate(LOW)), None] for d, t in docs.items()}
    c = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    score = lambda w: log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(map(score, ws))) for d, ws in tokens.items()}


def removed_bytes(docs, length=100):
    """{id: bytearray of flags} of bytes covered by a string of that length that also starts earlier."""
    seen, out = set(), {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        flags = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                flags[i : i + length] = b"\1" * length
            seen.add(part)
        out[d] = flags
    return out


def left_lines(docs, min_words=25, max_lines=8):
    """{id: text} without later copies of maximal runs of equal lines, by comparing every two places."""
    lines = {d: [(i, x.strip(" "), len(words(x))) for i, x in enumerate(t.split("\n")) if words(x)] for d, t in docs.items()}
    gone = {d: set() for d in docs}
    places = [(d, p) for d in sorted(docs) for p in range(len(lines[d]))]
    for at, (d, p) in enumerate(places):
        for e, q in places[:at]:
            a, b = lines[d], lines[e]
            if p and q and a[p - 1][1] == b[q - 1][1]:
                continue  # not where a maximal run begins
            n = 0
            while p + n < len(a) and q + n < len(b) and a[p + n][1] == b[q + n][1]:
                n += 1
            if n >= max_lines or sum(x[2] for x in a[p : p + n]) >= min_words:
                gone[d] |= {x[0] for x in a[p : p + n]}
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}
    return {d: t for d, t in left.items() if not gone[d] or words(t)}


def license_labels(text, templates, percent, run_lines):
    """Labels of the templates that any run of lines contains, and the best containment."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tokens = lambda t: word.findall(t.translate(LOW))
    most = 2 * max(len(tokens(t)) for _, t in templates)
    lines = [tokens(line) for line in text.split("\n")]
    labels, best = set(), 0.0
    for i in range(len(lines)):
        for k in range(1, run_lines + 1):
            run = [w for line in lines[i : i + k] for w in line]
            if i + k > len(lines) or (k > 1 and len(run) > most):
                continue
            for label, t in templates:
                own = set(tokens(t))
                share = len(own & set(run)) / len(own)
                if 100 * len(own & set(run)) >= percent * len(own):
                    labels.add(label)
                    best = max(best, share)
    return labels, best


def overlaps(docs, items, min_matched=13, mismatch=-2):
    """{(document, item): most equal words} of all ungapped alignments whose best stretch has enough of them."""
    at = {i: words((t or "").translate(LOW)) for i, t in items.items()}
    places = collections.defaultdict(list)
    for i, ws in at.items():
        for k, w in enumerate(ws):
            places[w].append((i, k))
    out = {}
    for d, text in docs.items():
        own = words((text or "").translate(LOW))
        shifts = collections.Counter((i, p - k) for p, w in enumerate(own) for i, k in places.get(w, ()))
        for (i, shift), equal in shifts.items():
            item = at[i]
            need = min(min_matched, -(-8 * len(item) // 10))
            if equal < need:
                continue
            best, score, matched, top = 0, 0, 0, 0
            for k, w in enumerate(item):
                p = shift + k
                if not 0 <= p < len(own):
                    continue
                same = own[p] == w
                score, matched = score + (1 if same else mismatch), matched + same
                if score <= 0:
                    score, matched = 0, 0
                elif score > best:
                    best, top = score, matched
            if top >= need:
                out[d, i] = max(out.get((d, i), 0), top)
    return out


def archived(pages):
    """{id: (bytes, digest, type, refers_to)} of pages by id, where equal payloads are stored once."""
    import base64
    import hashlib

    first = {}
    for i in sorted(pages):
        first.setdefault((pages[i] or "").encode(), i)
    out = {}
    for i, html in pages.items():
        data = (html or "").encode()
        same = first[data]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i] = (len(data), digest, "response" if same == i else "revisit", None if same == i else same)
    return out
