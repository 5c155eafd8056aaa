"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(docs, model):
    out = {}
    for i, t in docs:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        out[i] = (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(model.decode(ids)))
    return out


def op2_edits(docs):
    line = sorted(((i, t or "") for i, t in docs), reverse=True)
    out = {}
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        n = len(t) // 3
        out[i] = (len(t), sha(t[: len(t) - n] + after[:n]))
    return out


def op3(docs, width=3, limit=3):
    prints = {}
    for i, t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        runs = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    distinct = {}
    for i in sorted(prints):
        distinct.setdefault(prints[i], []).append(i)
    values = list(distinct)
    for a, x in enumerate(values):
        for i in distinct[x][1:]:
            root[find(i)] = find(distinct[x][0])
        for y in values[:a]:
            if (x ^ y).bit_count() <= limit:
                root[find(distinct[x][0])] = find(distinct[y][0])
    groups = {}
    for i in prints:
        groups.setdefault(find(i), []).append(i)
    return {i: (f"{prints[i]:016x}", min(groups[find(i)])) for i in prints}


def op6(docs):
    out = {}
    for i, t in docs:
        t = t or ""
        words = WORD.findall(t)
        seen, where = {}, set()
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                where.update(p + j for p in places for j in range(8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(where) > 30 * len(words)
        joined = "".join(words)
        out[i] = (len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(where), failed)
    return out


def op7(docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    for i, t in docs:
        words = word.findall((t or "").translate(LOWER))
        found = [(k, label) for k in range(len(words)) for p, label in phrases.items() if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in found]
        out[i] = (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
    return out


def op9(docs, length=400):
    seen = {}
    raws = {i: (t or "").encode() for i, t in docs}
    for i, raw in raws.items():
        for k in range(len(raw) - length + 1):
            seen.setdefault(raw[k : k + length], []).append((i, k))
    cover = {i: bytearray(len(r)) for i, r in raws.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                cover[i][k : k + length] = b"\1" * length
    out = {}
    for i, raw in raws.items():
        kept = bytes(c for c, x in zip(raw, cover[i], strict=True) if not x)
        out[i] = (len(raw), sum(cover[i]), len(re.findall(rb"\x01+", bytes(cover[i]))), sha(kept))
    return out


def passage_words(docs, length=51):
    """Words of each document inside a run of ``length`` words that another document holds too."""
    words = {i: (t or "").encode().split() for i, t in docs}
    seen = {}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            seen.setdefault(tuple(w[k : k + length]), []).append((i, k))
    cover = {i: set() for i in words}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                cover[i].update(range(k, k + length))
    return {i: len(c) for i, c in cover.items()}


def op10(docs):
    keys, out = {}, {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 40:
                keys.setdefault(key, set()).add(i)
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            holders = keys.get(line.strip(" \t\n\x0b\x0c\r").translate(LOWER), ())
            if len(holders) < 5 or max(holders) == i:
                stay.append(line)
        out[i] = (len(lines), len(lines) - len(stay), sha("\n".join(stay)))
    return out
