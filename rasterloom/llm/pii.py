"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Patterns find e-mail addresses, IP addresses, card and phone numbers in their usual spelling. A linear-chain CRF adds
those in other spellings (a phone number without country code, a card number with dots, a masked address). Its features
are word shapes only: classes of characters, length, neighbours' shapes and a few trigger words. It is trained on the
small labelled table ``labelled_lines`` (made from templates, part of this module) by gradient ascent on the exact
likelihood, and decoded by Viterbi in numpy, all segments of one length at a time.

A token without a digit or an at sign is never part of an item, in training and in decoding. So a text falls apart
into short independent segments around the other tokens, and only these are decoded. Added spans must not touch one
that a pattern found, and must hold enough digits for their kind.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; an empty table gives an empty
result; other columns are not read. All passes are linear in the text's length.
"""
from __future__ import annotations

import hashlib
import itertools
import random
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the look-behind only skips starts inside a run of digits whose beginning has failed: such starts fail as well
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each at sign has its own run of local characters, so one look at each is enough."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


# --- the random field ------------------------------------------------------------------------------
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
START_BAD = np.array([lab.startswith("I") for lab in LABELS])
#: I-x follows B-x or I-x only.
STEP_BAD = np.array([[b.startswith("I") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
#: Words before a number that tell what it is, and units behind it that tell what it is not (fixed values).
TRIGGERS = {"phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp"), "card": ("card", "visa", "mastercard", "amex"),
            "ip": ("ip", "host", "server", "address"), "email": ("email", "mail", "e-mail", "contact")}
BITS = 14


def shape(token: str) -> str:
    """Character classes of a token, runs of letters shortened, runs of digits up to their length of 5."""
    out = []
    for same, run in itertools.groupby("9" if c in "0123456789" else "a" if c.isalpha() else c for c in token):
        n = len(list(run))
        out.append(same * min(n, 5) if same == "9" else same)
    return "".join(out)


def token_features(tokens: list[str], before: str, after: str) -> list[list[int]]:
    """Hashed features of each token of a segment; ``before`` and ``after`` are the words around it."""
    shapes = [shape(t) for t in tokens]
    trigger = next((k for k, words in TRIGGERS.items() if before.lower().strip(":.,;()#") in words), "-")
    out = []
    for i, (t, s) in enumerate(zip(tokens, shapes)):
        left = shapes[i - 1] if i else "^"
        right = shapes[i + 1] if i + 1 < len(shapes) else "$"
        n = sum(c in "0123456789" for c in t)
        names = [f"s {s}", f"n {min(n, 20)}", f"l {left} {s}", f"r {s} {right}", f"c {''.join(sorted(set(s)))}", f"t {trigger} {min(i, 1)}", f"k {len(tokens)} {s}"]
        out.append([xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names])
    return out


def segments(text: str) -> list[tuple[list[tuple[int, int]], str, str]]:
    """Runs of neighbouring tokens that hold a digit or an at sign: their spans, the word before and the word after."""
    spans, end = [], 0
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        spans.append((a, b))
        end = b
    out = []
    for a, b in spans:
        gap = text[out[-1][-1][1]:a] if out else None
        if gap is not None and len(gap) == 1 and gap != "\n":
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    found = []
    for run in out:
        before, after = text[max(0, run[0][0] - 24):run[0][0]].split(), text[run[-1][1]:run[-1][1] + 24].split()
        found.append((run, before[-1] if before else "", after[0] if after else ""))
    return found


@dataclass
class Field:
    emit: np.ndarray                 # (2^BITS, labels)
    step: np.ndarray                 # (labels, labels)
    first: np.ndarray                # (labels,)

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """(segments, length, labels) from (segments, length, features)."""
        return self.emit[feats].sum(2)

    def viterbi(self, feats: np.ndarray) -> np.ndarray:
        """Best label sequences of segments of one length, as (segments, length)."""
        e, step = self.scores(feats), np.where(STEP_BAD, -1e9, self.step)
        best = e[:, 0] + np.where(START_BAD, -1e9, self.first)
        back = []
        for t in range(1, e.shape[1]):
            both = best[:, :, None] + step[None]
            back.append(both.argmax(1))
            best = both.max(1) + e[:, t]
        path = [best.argmax(1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], 1)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train_field(lines: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 150, rate: float = 0.2, l2: float = 2e-4) -> Field:
    """Exact maximum likelihood (forward-backward), Adagrad over the whole table; segments of a length are one batch."""
    by_len: dict[int, list] = {}
    for text, spans in lines:
        for run, before, after in segments(text):
            labels = []
            for a, b in run:
                own = next(((k, s) for k, s, e in spans if a < e and b > s), None)
                labels.append(0 if own is None else LABELS.index(("B-" if a <= own[1] else "I-") + own[0]))
            by_len.setdefault(len(run), []).append((token_features([text[a:b] for a, b in run], before, after), labels))
    groups = [(np.array([f for f, _ in rows]), np.array([y for _, y in rows])) for rows in by_len.values()]
    k = len(LABELS)
    model = Field(np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k))
    sums = [np.full(p.shape, 1e-6) for p in (model.emit, model.step, model.first)]
    total = sum(len(y) for _, y in groups)
    for _ in range(rounds):
        grads = [-l2 * model.emit, -l2 * model.step, -l2 * model.first]
        for feats, y in groups:
            n, length = y.shape
            e, step = model.scores(feats), np.where(STEP_BAD, -1e9, model.step)
            fwd, bwd = [e[:, 0] + np.where(START_BAD, -1e9, model.first)], [np.zeros((n, k))]
            for t in range(1, length):
                fwd.append(_sum_exp(fwd[-1][:, :, None] + step[None], 1) + e[:, t])
            for t in range(length - 1, 0, -1):
                bwd.append(_sum_exp(step[None] + (e[:, t] + bwd[-1])[:, None, :], 2))
            bwd.reverse()
            z = _sum_exp(fwd[-1], 1)
            one = np.eye(k)
            for t in range(length):
                diff = (one[y[:, t]] - np.exp(fwd[t] + bwd[t] - z[:, None])) / total
                np.add.at(grads[0], feats[:, t], diff[:, None, :])
                if t == 0:
                    grads[2] += diff.sum(0)
                else:
                    joint = np.exp(fwd[t - 1][:, :, None] + step[None] + (e[:, t] + bwd[t])[:, None, :] - z[:, None, None])
                    real = np.zeros((k, k))
                    np.add.at(real, (y[:, t - 1], y[:, t]), 1)
                    grads[1] += (real - joint.sum(0)) / total
        for p, g, s in zip((model.emit, model.step, model.first), grads, sums):
            s += g * g
            p += rate * g / np.sqrt(s)
    return model


def labelled_lines(copies: int = 40, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: short lines with items of each kind in several spellings, and with numbers that are none."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    low = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    octet = lambda: str(rng.randint(1, 255))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: low(rng.randint(2, 9))
    items = {
        "email": [lambda: f"{low(5)}.{num(2)}@{low(5)}{num(1)}.example.com", lambda: f"{low(6)}@{low(6)}.org", lambda: f"{low(4)}@{low(5)}", lambda: f"{low(5)}{num(2)}@{low(4)}.{low(3)}"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)) + f":{num(4)}"],
        "card": [lambda: "4" + num(15), lambda: f"4{num(3)} {num(4)} {num(4)} {num(4)}", lambda: f"5{num(3)}-{num(4)}-{num(4)}-{num(4)}",
                 lambda: f"4{num(3)}.{num(4)}.{num(4)}.{num(4)}", lambda: f"3{num(3)} {num(6)} {num(5)}"],
        "phone": [lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}",
                  lambda: f"+{num(2)} {num(3)} {num(7)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)}.{num(3)}.{num(6)}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}"],
    }
    none = [lambda: num(4), lambda: num(1), lambda: num(2), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.", lambda: f"{num(3)}.",
            lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(2)}%", lambda: f"${num(3)}.{num(2)}", lambda: f"password={hexed(18)}", lambda: f'"{hexed(40)}"',
            lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: num(6), lambda: num(8), lambda: num(10), lambda: num(12), lambda: f"{num(2)},{num(3)}",
            lambda: f"{num(3)} {num(3)}", lambda: f"{num(4)} {num(4)}", lambda: f"v{num(1)}.{num(2)}", lambda: f"{low(3)}{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(4)}-{num(4)}",
            lambda: f"[{num(2)}]", lambda: f"({num(4)})", lambda: f"{num(3)}-{num(4)}", lambda: f"{num(5)} {num(4)}", lambda: f"@{low(6)}", lambda: " ".join(num(2) for _ in range(6)),
            lambda: " ".join(num(rng.randint(1, 6)) for _ in range(rng.randint(2, 9)))]
    out = []
    for _ in range(copies):
        for kind, make in [(k, f) for k, fs in items.items() for f in fs] + [(None, f) for f in none for _ in range(2)]:
            cue = rng.choice(TRIGGERS[kind]) if kind and rng.random() < 0.3 else word()
            item, tail = make(), rng.choice(["", "", ".", ","])
            head = f"{word()} {word()} {cue} "
            text = f"{head}{item}{tail} {word()} {word()}"
            out.append((text, [(kind, len(head), len(head) + len(item))] if kind else []))
    return out


#: Digits an added span must hold, lowest and highest.
NEED = {"email": (0, 99), "ip": (4, 17), "card": (13, 19), "phone": (10, 15)}
EDGE = ".,;:!?\"'()[]{}<>|#$%&*"


def field_spans(text: str, model: Field, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans the random field finds outside ``taken``."""
    found = segments(text)
    used = sorted((a, b) for _, a, b in taken)
    touched = lambda a, b: any(a < y and b > x for x, y in used)
    by_len: dict[int, list] = {}
    for run, before, after in found:
        by_len.setdefault(len(run), []).append((run, token_features([text[a:b] for a, b in run], before, after)))
    out = []
    for rows in by_len.values():
        for (run, _), path in zip(rows, model.viterbi(np.array([f for _, f in rows]))):
            at = 0
            while at < len(run):
                lab = LABELS[path[at]]
                if lab == "O":
                    at += 1
                    continue
                end = at + 1
                while end < len(run) and LABELS[path[end]] == f"I-{lab[2:]}":
                    end += 1
                a, b = run[at][0], run[end - 1][1]
                while a < b and text[a] in EDGE and not (text[a] == "(" and lab[2:] == "phone"):
                    a += 1
                while b > a and text[b - 1] in EDGE:
                    b -= 1
                n = len(DIGIT.findall(text[a:b]))
                if NEED[lab[2:]][0] <= n <= NEED[lab[2:]][1] and not touched(a, b) and _plausible(lab[2:], text[a:b]):
                    out.append((lab[2:], a, b))
                at = end
    return out


def _plausible(kind: str, item: str) -> bool:
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+@[^@\s]+", item))
    if kind == "card":
        return luhn("".join(DIGIT.findall(item))) and not re.search(r"[^0-9\x20._-]", item)
    if kind == "ip":
        return item.count(".") >= 3 and all(int(p) <= 255 for p in re.split(r"[.:/]", item)[:4] if p.isdigit())
    return not re.search(r"[^0-9\x20().+-]", item) and bool(re.search(r"[\x20().-]", item))


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """(doc_id, base, added): pattern spans and the field's spans as strings of kind:start:end, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train_field(labelled_lines()))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(ids, texts):
        base, extra, digest, counts = [], [], [], {k: [] for k in KINDS}
        for t in texts:
            plain = (t or b"").decode()
            own = pattern_spans(plain)
            more = field_spans(plain, shared.value, own)
            base.append(joined(own))
            extra.append(joined(own + more))
            digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in own))
        return {"doc_id": ids, "base": base, "base_sha256": digest, "spans": extra, **{f"n_{k}": v for k, v in counts.items()}}

    return arrow_map(named, run, f"doc_id {dict(named.dtypes)['doc_id']}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                     + ", base string, base_sha256 string, spans string", "doc_id", "text")


def masked(text: str, spans: str) -> str:
    """The text with each span of a ``spans`` string replaced by its kind in brackets; of overlapping ones the first counts."""
    out, at = [], 0
    for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: (int(s[1]), -int(s[2]))):
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind}]"]
            at = int(b)
    return "".join(out) + text[at:]
