"""Small tables with the awkward cases, and brute-force versions of the operators that SQL cannot express."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LONG_LINE = " ".join(f"shared{i}" for i in range(60)) + "."


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): ordinary texts, copies, near copies, shared passages, and every odd case."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 14))).capitalize() + "."
    texts = ["\n".join(" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    texts[5] = texts[4]
    texts[7] = texts[6].replace(texts[6].split()[3], "changed", 1)
    for i in (10, 20, 30):
        texts[i] = texts[i] + "\n" + LONG_LINE
    for i in (11, 21):
        texts[i] = "First shared line here.\nSecond shared line there.\n" + texts[i]
    for i in (12, 22, 32, 42):
        texts[i] += " You are a worthless idiot."
    texts[13] += " Write to jo.doe@mail.example.com or +1 (988) 555-2485, host 10.1.2.3, card 4111 1111 1111 1111."
    texts[14] = "ÉTÉ déjà vu 漢字 🙂  two  blanks\tand\ttabs\r\nİstanbul it's 'S we'LL  "
    texts[15] = "x"
    texts[16] = " \n\t \n"
    texts[17] = ""
    texts[18] = "la " * 300
    texts[19] = "nospace" * 4000
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None, None, None, None), (None, "No id at all. Some words are here.", "en", "s", 3), (1001, texts[0], "en", "s", 9), (3, texts[3], "en", "src0", 9)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower_words(text):
    return (text or "").encode().lower().split()


def ppm(docs, trained, order):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score, score)} from nested dictionaries."""
    followers, words = [defaultdict(Counter) for _ in range(order + 1)], Counter()
    bytes_of = lambda t: [0xFE] * order + list((t or "").encode().lower()) + [0xFF]
    for i, t in docs:
        if trained(i):
            s = bytes_of(t)
            for p in range(order, len(s)):
                for k in range(order + 1):
                    followers[k][tuple(s[p - k:p])][s[p]] += 1
            words.update([*lower_words(t), b" "])
    n, v, out = sum(words.values()), len(words), {}
    for i, t in docs:
        s, score = bytes_of(t), 0.0
        for p in range(order, len(s)):
            hidden, share = set(), 1.0
            for k in range(order, -1, -1):
                seen = {a: c for a, c in followers[k].get(tuple(s[p - k:p]), {}).items() if a not in hidden}
                if not seen:
                    continue
                size = sum(seen.values()) + len(seen)
                if s[p] in seen:
                    share *= seen[s[p]] / size
                    break
                share *= len(seen) / size
                hidden |= set(seen)
            else:
                share /= 256 - len(hidden)
            score += math.log10(share)
        own = [*lower_words(t), b" "]
        out[i] = (len(own), sum(words[w] > 0 for w in own), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), score)
    return out


def fingerprint(text):
    w = lower_words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def jaccard(a, b, k=5):
    def grams(t):
        w = lower_words(t)
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def without_repeated_lines(rows, chunks):
    """[(doc_id, text)] after removal of all but the first occurrence of each chunk; rows with equal id and text are one document."""
    places, drop = set(), defaultdict(set)
    for known, i, t in sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}):
        lines = t.split("\n")
        for s, k in sorted(chunks(t)):
            chunk = "\n".join(lines[s:s + k])
            if chunk in places:
                drop[known, i, t].update(range(s, s + k))
            places.add(chunk)
    out = []
    for i, t in rows:
        gone = drop.get((i is not None, i or 0, t), ())
        out.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) if gone else t))
    return out


def item_words(text):
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").encode().lower().decode()).split()


def benchmark_hits(rows, items, window=10):
    """[(doc_id, n_words, n_hit, item ids)] by comparing every window with every place."""
    windows = [(i, tuple(w[k:k + min(window, len(w))])) for i, t in items for w in [item_words(t)] if w for k in range(len(w) - min(window, len(w)) + 1)]
    out = []
    for i, t in rows:
        w, hit, ids = item_words(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), ",".join(sorted(ids))))
    return out


def one_of_each_group(rows, similarity=0.8):
    """Rows whose id is the smallest of a group connected by similar texts; of equal ids the first row."""
    rows = sorted({i: (i, t) for i, t in rows}.values())
    comp = components(len(rows), lambda a, b: jaccard(rows[a][1], rows[b][1]) >= similarity)
    return [r for k, r in enumerate(rows) if comp[k] == k]


def pii_spans(text):
    """Base spans by plain backtracking patterns."""
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
