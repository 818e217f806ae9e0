"""Plain-Python versions of the alignment, id-file and variant operators."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SIDE_A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SIDE_A.encode_special_tokens = True
SIDE_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _letters():
    keep = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = _letters()


def groups_of(text):
    """Lists of (A ids, B ids) of the groups of one text."""
    if not text:
        return []
    whole = (" " + text).encode()
    a, b = SIDE_A.encode(" " + text, add_special_tokens=False).ids, SIDE_B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in SIDE_A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(SIDE_B.id_to_piece(i)[3:5], 16)]) if SIDE_B.is_byte(i) else SIDE_B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []

    def ended(ids, parts):
        at, out = 0, {}
        for i, part in zip(ids, parts):
            at += len(part)
            out[at] = out.get(at, []) + [i]
        return out

    ends_a, ends_b = ended(a, a_bytes), ended(b, b_bytes)
    both = sorted(set(ends_a) & set(ends_b))
    inside = lambda ends, low, high: [i for e in sorted(ends) if low < e <= high for i in ends[e]]
    return [(inside(ends_a, low, high), inside(ends_b, low, high)) for low, high in zip([0, *both], both)]


def alignments(rows):
    """Counts, best links and digests of rows of (id, text), in order."""
    groups = [groups_of(t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = collections.Counter(p for found in links for p in set(found))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), g, found in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(found),
            sum(count[p] == top[p[0]] for p in found), sum(count[p] for p in found),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def id_rows(rows):
    """(id, start, n_tokens, crc32) of rows already in document order."""
    at, out = 0, []
    for i, t in rows:
        ids = [*WORDS.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def variants(rows):
    """word, form, root, n, n_near, form_n from rows of (id, text)."""
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    holes = collections.defaultdict(set)  # words that are equal once one place is blanked or filled
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1 :]].add(w)
        for k in range(len(w) + 1):
            holes[w[:k] + "*" + w[k:]].add(w)
    near = collections.defaultdict(set)
    for found in holes.values():
        for w in found:
            near[w] |= {x for x in found if x != w and abs(len(x) - len(w)) <= 1}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())
