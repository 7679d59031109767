"""Plain versions of operators, for small inputs."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

from vaultline.llm import lines, suffixes


def brute_lines(texts):
    seen, gone = [], {}
    for i, t in enumerate(texts):
        for j, line in enumerate((t or "").split("\n")):
            w = lines.words_of(line)
            if len(w) < lines.MIN_WORDS:
                continue
            near = lambda v: len(v) >= lines.NEAR_WORDS and len(w) >= lines.NEAR_WORDS and lines.within_one(v, w)  # noqa: B023, E731
            if any(v == w or near(v) for v in seen):
                gone.setdefault(i, []).append(j)
            seen.append(w)
    return gone


def brute_repeats(texts):
    """(bytes, bytes removed, runs, digest of what stays) of each text."""
    out = []
    for t, hit in brute_covered(texts):
        runs = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~hit])).hexdigest()))
    return out


def brute_covered(texts):
    """(bytes, which of them a repeated string covers) of each text."""
    data = [(t or "").encode() for t in texts]
    n = suffixes.LENGTH
    count = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    out = []
    for t in data:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i : i + n] = True
        out.append((t, hit))
    return out


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in low.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, texts):
    """The smallest id that links within four bits reach, for each text."""
    fps, best = [slow_fingerprint(t) for t in texts], dict(enumerate(ids))
    changed = True
    while changed:
        changed = False
        for i, j in ((i, j) for i in best for j in best if (fps[i] ^ fps[j]).bit_count() <= 4):
            if best[j] < best[i]:
                best[i], changed = best[j], True
    return [best[i] for i in range(len(ids))]


def brute_language(texts, langs, held, least=3):
    """(language, score, share of words that are backed) of each text by words and n-grams of those that aren't held out, word by word."""
    import math
    import re

    words = lambda t: re.findall(r"[^\W\d_]{1,64}", (t or "").lower())
    known = sorted({k for k, h, t in zip(langs, held, texts, strict=True) if k is not None and t is not None and not h})
    docs, count, grams = Counter(), {k: Counter() for k in known}, {k: Counter() for k in known}
    for t, k, h in zip(texts, langs, held, strict=True):
        if k is None or t is None or h:
            continue
        docs[k] += 1
        for w in words(t):
            count[k][w] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    grams[k][f"^{w}$"[i : i + n]] += 1
    every_word, every_gram = sum(count.values(), Counter()), sum(grams.values(), Counter())
    mass = {k: sum(count[k].values()) for k in known}
    frequent = {g for g, n in every_gram.items() if n >= least}
    sizes = {k: Counter() for k in known}
    for k in known:
        for g, n in grams[k].items():
            if g in frequent:
                sizes[k][len(g)] += n
    floor = min(math.log(0.5 / (mass[k] + 1)) for k in known)

    def of(w, k):
        if every_word[w] >= least:
            return math.log((count[k][w] + 0.5) / (mass[k] + 1))
        for n in range(5, 0, -1):
            found = [g for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in frequent]
            if found:
                return sum(math.log((grams[k][g] + 0.5) / (sizes[k][n] + 1)) for g in found) / len(found)
        return floor

    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0, 0.0))
            continue
        z = {k: math.log(docs[k] / sum(docs.values())) + sum(of(w, k) for w in words(t)) for k in known}
        best = max(known, key=lambda k: z[k])
        backed = [every_word[w] >= least or any(f"^{w}$"[i : i + n] in frequent for n in (3, 4, 5) for i in range(len(w) + 3 - n)) for w in words(t)]
        out.append((best, 1 / sum(math.exp(max(-700, z[k] - z[best])) for k in known), sum(backed) / len(backed)))
    return out


def slow_sketch(text, size=64):
    """The smallest hashes of the phrase names of a text, symbol by symbol."""
    word = 2**64 - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0x9E3779B97F4A7C15 & word
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & word
        return x ^ x >> 32

    def toss(before, own):
        k = ((before ^ own) & -(before ^ own)).bit_length() - 1 if before != own else 0
        return 2 * k + (own >> k & 1)

    def phrases(symbols):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        s = [x if n == 1 else mix(x + n * 0xD6E8FEB86659FD93 & word) for x, n in runs]
        label = [s[0] & 1] + [toss(a, b) for a, b in zip(s, s[1:])]
        for _ in range(3):
            label = [label[0] & 1] + [toss(a, b) for a, b in zip(label, label[1:])]
        starts = [0] + [i for i in range(2, len(s) - 1) if label[i - 1] < label[i] > label[i + 1]]
        return [mix(sum(mix(s[i] + mix(i - a + 1) & word) for i in range(a, b)) & word) for a, b in zip(starts, [*starts[1:], len(s)])]

    symbols, names, level = [ord(c) for c in text], set(), 0
    while symbols:
        if level or len(symbols) == 1:
            names |= {mix(x) >> 32 for x in symbols}
        if len(symbols) == 1:
            break
        symbols, level = phrases(symbols), level + 1
    return sorted(names)[:size]


def slow_likeness(a, b, size=64):
    both = sorted(set(a) | set(b))[:size]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def brute_jaccard(texts, width=5, similarity=0.8):
    """The number of the first text that links of at least this likeness of word shingles reach, for each text."""
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    label = list(range(len(texts)))
    links = [(i, j) for i in label for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label
