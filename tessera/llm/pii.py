"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The network is trained in numpy from labelled spans: those of the patterns in a bounded sample of documents, and made-up
ones in other spellings set into lines of that sample, beside numbers that are not personal data. Whole texts are cut into
overlapping windows; each is decoded by Viterbi, and the spans of all windows of a text are reconciled: those found
farthest from a window's edge come first, and what overlaps an accepted span goes. Spans of one kind that windows cut are
joined first. A span counts only if it holds a mark (a digit, an at-sign, or one spelled out; see plausible), so the windows
that no span with a mark can reach need no decoding: whatever the network said of them, nothing of it could count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one to the next.
WINDOW, STRIDE = 96, 48
#: Bounds of the training: documents, about, that its windows come from (those of the least hash), windows of one document
#: and windows in all (again those of the least hash). Each is used twice: with its base spans, and with an invented span.
FIT_DOCS, FIT_PER_DOC, FIT_WINDOWS = 4000, 4, 600
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 16, 12, 64, 0.025
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Every plausible span holds one of these.
_MARK = re.compile(r"[0-9@]|\(at\)|\[at\]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans in order of start, then kind: leftmost and not overlapping within a kind; a match that fails its test is dropped."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):  # the local part is the run before the at-sign, from the last address on
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, 0, last := m.end()))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def code_points(text: str) -> np.ndarray:
    """Input symbols: printable ASCII as such, then white space, lower, upper and other characters beyond it; 0 pads."""
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((p >= 32) & (p < 127), p - 31, 98).astype(np.int16)
    out[(p == 10) | (p == 13) | (p == 9)] = 97
    for k in np.flatnonzero(p >= 128).tolist():
        c = text[k]
        out[k] = 99 if c.islower() else 100 if c.isupper() else 101 if c.isspace() else 98
    return out


SYMBOLS = 102


def windows(text: str) -> Iterable[tuple[int, str]]:
    """(start, characters) of the overlapping windows of a text that hold a mark or a part of one, and of the ones beside an email's mark, which may hold the rest of its span."""
    need: set[int] = set()
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    for m in _MARK.finditer(text):
        k = m.start() // STRIDE
        need.update((min(k, last), min(max(0, k - 1), last), min((m.end() - 1) // STRIDE, last)))
        if m[0][0] in "@([":
            need.update((min(max(0, k - 2), last), min(k + 1, last)))
    for k in sorted(need):
        yield k * STRIDE, text[k * STRIDE : k * STRIDE + WINDOW]


def tags_of(spans: Iterable[Span], start: int, size: int) -> np.ndarray:
    """Tags of a window; a span that the window cuts is inside from the window's edge on."""
    out = np.zeros(size, np.int8)
    for s, kind, e in spans:
        a, b = max(s - start, 0), min(e - start, size)
        if a < b:
            out[a:b] = 2 + 2 * kind
            if s >= start:
                out[a] = 1 + 2 * kind
    return out


class Tagger:
    """Bidirectional LSTM over characters with CRF transitions."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": (0.3 * r.standard_normal((SYMBOLS, EMBED))).astype(np.float32), "out": g(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (time, batch) symbols; padding leaves the state as it is."""
        n = HIDDEN
        pre = (self.p["emb"] @ self.p[f"x{d}"] + self.p[f"c{d}"])[x]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, tape = np.zeros((*x.shape, n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c1 = f * c + i * g
            tc = np.tanh(c1)
            if keep:
                tape.append((t, i, f, o, g, tc, c, h, m))
            c, h = np.where(m, c1, c), np.where(m, o * tc, h)
            out[t] = h
        return out, tape

    def _lstm_back(self, grad: np.ndarray, tape: list, x: np.ndarray, d: str, g_: dict) -> None:
        w = self.p[f"h{d}"]
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        gates = np.zeros((*x.shape, 4 * HIDDEN), np.float32)
        for t, i, f, o, g, tc, c, h, m in reversed(tape):
            dh = dh + grad[t]
            dcc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate([dcc * g * i * (1 - i), dcc * c * f * (1 - f), dh * tc * o * (1 - o), dcc * i * (1 - g * g)], axis=1) * m
            gates[t] = z
            g_[f"h{d}"] += h.T @ z
            dh, dc = np.where(m, z @ w.T, dh), np.where(m, dcc * f, dc)
        flat, at = gates.reshape(-1, 4 * HIDDEN), x.reshape(-1)
        by = np.zeros((SYMBOLS, 4 * HIDDEN), np.float32)
        np.add.at(by, at, flat)
        g_[f"c{d}"] += flat.sum(axis=0)
        g_[f"x{d}"] += self.p["emb"].T @ by
        g_["emb"] += by @ self.p[f"x{d}"].T

    def emissions(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._lstm(x, mask, "f", keep)
        b, tb = self._lstm(x, mask, "b", keep)
        h = np.concatenate([f, b], axis=2)
        return h @ self.p["out"] + self.p["bias"], h, tf, tb

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags y, and its gradients."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        e, h, tf, tb = self.emissions(x, mask, True)
        steps, n = x.shape
        trans, first = self.p["trans"], self.p["first"]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + first
        for t in range(1, steps):
            alpha[t] = np.where(mask[t][:, None], lse(alpha[t - 1][:, :, None] + trans, 1) + e[t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(mask[t + 1][:, None], lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None]) * mask[:, :, None]
        at = np.arange(n)
        gold = e[0][at, y[0]] + first[y[0]]
        g["first"] += de[0].sum(axis=0)
        np.add.at(g["first"], y[0], -1)
        on = mask[1:]
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        g["trans"] += np.einsum("tbij,tb->ij", pair, on.astype(np.float32))
        np.subtract.at(g["trans"], (y[:-1][on], y[1:][on]), 1)
        gold = gold + (np.where(on, trans[y[:-1], y[1:]] + np.take_along_axis(e[1:], y[1:, :, None], 2)[:, :, 0], 0)).sum(axis=0)
        np.subtract.at(de, (np.repeat(np.arange(steps), n)[mask.reshape(-1)], np.tile(at, steps)[mask.reshape(-1)], y.reshape(-1)[mask.reshape(-1)]), 1)
        de /= n
        g["trans"], g["first"] = g["trans"] / n, g["first"] / n
        flat = h.reshape(-1, 2 * HIDDEN)
        g["out"] += flat.T @ de.reshape(-1, TAGS)
        g["bias"] += de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        self._lstm_back(dh[:, :, :HIDDEN], tf, x, "f", g)
        self._lstm_back(dh[:, :, HIDDEN:], tb, x, "b", g)
        return float((z - gold).mean()), g

    def train(self, texts: list[str], tags: list[np.ndarray], seed: int = 4) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, last = 0, 0.0
        for epoch in range(EPOCHS):
            order, losses = rng.permutation(len(texts)), []
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                x, mask = pad([texts[i] for i in own])
                y = np.zeros(x.shape, np.int64)
                for j, i in enumerate(own):
                    y[: len(tags[i]), j] = tags[i]
                loss, g = self.loss(x, mask, y)
                losses.append(loss)
                step += 1
                rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / EPOCHS))
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for name, v in g.items():
                    v = v * min(1.0, 5 / max(size, 1e-9))
                    m1[name] = 0.9 * m1[name] + 0.1 * v
                    m2[name] = 0.99 * m2[name] + 0.01 * v * v
                    self.p[name] = (self.p[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    def decode(self, texts: list[str]) -> list[np.ndarray]:
        """The best tags of each text (Viterbi)."""
        x, mask = pad(texts)
        e = self.emissions(x, mask)[0]
        steps, n = x.shape
        score, back = e[0] + self.p["first"], np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            s = score[:, :, None] + self.p["trans"]
            back[t] = s.argmax(axis=1)
            score = np.where(mask[t][:, None], s.max(axis=1) + e[t], score)
        best = score.argmax(axis=1)
        tags = np.zeros((steps, n), np.int8)
        for t in range(steps - 1, -1, -1):
            tags[t] = np.where(mask[t], best, 0)
            if t:
                best = np.where(mask[t], back[t][np.arange(n), best], best)
        return [tags[: len(s), k] for k, s in enumerate(texts)]


def pad(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(1, max(map(len, texts), default=1)), len(texts)), np.int16)
    for k, t in enumerate(texts):
        x[: len(t), k] = code_points(t)
    mask = np.arange(len(x))[:, None] < np.array([len(t) for t in texts])
    return x, mask


#: Characters of a span, at most, with what may separate digits; of the kinds in order. An address has 64 before the sign and 255 behind it.
LONGEST = (320, 96, 96, 96)


def plausible(kind: int, s: str) -> bool:
    """Whether characters that the network marks can be personal data of the kind at all."""
    n = len(_digits(s))
    if kind == 0:
        return re.fullmatch(r"[\w.%+-]{2,}\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+", s) is not None and _MARK.search(s) is not None
    if kind == 1:
        parts = re.fullmatch(r"(\d{1,3})[.,](\d{1,3})[.,](\d{1,3})[.,](\d{1,3})", s, re.ASCII)
        return parts is not None and all(int(p) <= 255 for p in parts.groups())
    if kind == 2:
        return re.fullmatch(r"[0-9][0-9 ./-]*[0-9]", s) is not None and 13 <= n <= 19 and luhn(_digits(s))
    return re.fullmatch(r"(?:\+|\(|00)?[0-9][0-9 ()./-]*[0-9]", s) is not None and 9 <= n <= 15 and re.search(r"[ ()./-]", s) is not None


def _joined(found: Iterable[tuple[int, Span]]) -> set[tuple[int, Span]]:
    """The pieces, and in order of their start those of one kind that overlap or touch put together; a joined span comes as if no edge had cut it.

    Spans longer than their kind can be aren't made, so a start meets the pieces within that length only, however long a chain is.
    """
    out = set(found)
    for kind, longest in enumerate(LONGEST):
        own = sorted((s, e) for _, (s, k, e) in out if k == kind)
        for (s, e), more in zip(own, range(1, len(own) + 1), strict=True):
            for k in range(more, len(own)):
                a, b = own[k]
                if a > e or a - s > longest:
                    break
                if e < b <= s + longest:
                    e = b
                    out.add((WINDOW, (s, kind, e)))
    return out


class _Taken:
    """Characters that spans cover, as disjoint intervals in order."""

    def __init__(self, spans: Iterable[Span]):
        self.starts, self.ends = [], []
        for s, _, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)
        return k < len(self.starts) and self.starts[k] < e

    def add(self, s: int, e: int) -> None:
        k = bisect_right(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def reconcile(text: str, base: list[Span], found: Iterable[tuple[int, Span]]) -> list[Span]:
    """Base spans and those of (distance from the window's edge, span) that are plausible and overlap neither a base span nor one accepted before. Of equal distances the longer span comes first, then the one that starts earlier, then the kind listed first."""
    out, taken = list(base), _Taken(base)
    for _, (s, kind, e) in sorted(_joined(found), key=lambda f: (-f[0], f[1][0] - f[1][2], f[1])):
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        if s < e and whole and not taken.meets(s, e) and plausible(kind, text[s:e]):
            out.append((s, kind, e))
            taken.add(s, e)
    return sorted(out)


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each whole text."""
    cut = [(k, start, s) for k, t in enumerate(texts) for start, s in windows(t)]
    found: list[set] = [set() for _ in texts]
    cut.sort(key=lambda c: len(c[2]))
    for b in range(0, len(cut), 512):
        part = cut[b : b + 512]
        for (k, start, s), tags in zip(part, tagger.decode([c[2] for c in part]), strict=True):
            at = 0
            for at in np.flatnonzero((tags > 0) & ((tags & 1 == 1) | (np.append(0, tags[:-1]) != tags) & (np.append(0, tags[:-1]) != tags - 1))).tolist():
                kind = (int(tags[at]) - 1) // 2
                end = at + 1
                while end < len(s) and tags[end] == 2 + 2 * kind:
                    end += 1
                margin = min(at if start else WINDOW, len(s) - end if start + len(s) < len(texts[k]) else WINDOW)
                found[k].add((margin, (start + at, kind, start + end)))
    return [(base := base_spans(t), reconcile(t, base, f)) for t, f in zip(texts, found, strict=True)]


def _invented(rng: np.random.Generator) -> tuple[str, int]:
    """Characters and their kind: personal data in many spellings; -1: numbers that are none."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9)))
    one = lambda *x: x[rng.integers(len(x))]
    match rng.integers(10):
        case 0 | 1:
            at, dot = one(("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."))
            return f"{w()}{one('.', '_', '-', '')}{one(w(), d(2))}{at}{w()}{d(rng.integers(0, 2))}{dot}{one('com', 'org', 'net', 'example.com'.replace('.', dot))}", 0
        case 2:
            return ".".join(str(v) for v in rng.integers(0, 256, 4)), 1
        case 3 | 4:
            n = d(int(rng.integers(12, 19)))
            n += str(next(c for c in range(10) if luhn(n + str(c))))
            return one(n, n, one(" ", "-", ".").join(n[k : k + 4] for k in range(0, len(n), 4))), 2
        case 5 | 6 | 7:
            a, b, c = d(3), d(3), d(4)
            return one(f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"00{rng.integers(20, 60)} {a} {b}{c}", f"0{d(3)} {b}{c}"), 3
        case _:
            return one(f"{d(1)}.{d(1)}", f"20{d(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}", f"20{d(2)}", d(int(rng.integers(1, 6))), f"{d(2)}.{d(2)}%", f"${d(3)}", f'token = "{rng.bytes(8).hex()}"', f"version {d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}", rng.bytes(16).hex()), -1


def training_windows(texts: list[str], seed: int = 9) -> tuple[list[str], list[np.ndarray]]:
    """Windows with tags: as they are with their base spans, and each once more with an invented span set in between two words."""
    rng = np.random.default_rng(seed)
    out, tags = [], []
    for t in texts:
        out.append(t[:WINDOW])
        tags.append(tags_of(base_spans(t), 0, len(out[-1])))
        plain = " ".join(x for x in t.split() if not _MARK.search(x)).split(" ")
        s, kind = _invented(rng)
        k = int(rng.integers(len(plain) + 1))
        before = " ".join(plain[:k])[-int(rng.integers(1, WINDOW - 30)) :]
        before += " " * bool(before)
        made = before + s + ("" if rng.random() < 0.2 else "." if rng.random() < 0.2 else " ") + " ".join(plain[k:])
        out.append(made[:WINDOW])
        tags.append(tags_of([(len(before), kind, len(before) + len(s))] if kind >= 0 else [], 0, len(out[-1])))
    return out, tags


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Tagger:
    """A tagger from FIT_WINDOWS windows at most of about FIT_DOCS documents; without any, from invented spans alone."""

    def run(batches):
        for b in batches:
            cut = []
            for t in b.column("text").to_pylist():
                own = [w for _, w in windows(t)] or [t[len(t) // 2 :][:WINDOW]]
                cut += sorted(own, key=xxhash.xxh64_intdigest)[:FIT_PER_DOC]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], ["w"])

    n = docs.count()
    every = max(1, n // FIT_DOCS)
    chosen = docs.where(F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(every)) == 0, F.lit(True))).select(text_or_empty(text).alias("text"))
    marked = chosen.mapInArrow(run, "w string").where(F.length("w") > 0)
    got = [r.w for r in marked.orderBy(F.xxhash64("w"), "w").limit(FIT_WINDOWS).collect()]
    tagger = Tagger()
    tagger.train(*training_windows(got or ["some words of a text without any numbers in it"] * 200))
    return tagger


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end in code points, end exclusive, by start, then kind) of every row.

    base holds the patterns' spans, spans these and what the network adds. Null and empty texts have none; null ids and
    repeated rows pass through; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, doc_id))
    kinds = docs.schema[doc_id].dataType.simpleString()
    struct = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                found = find(part.column("text").to_pylist(), shared.value)
                cols = [pa.array([[{"start": s, "kind": KINDS[kind], "end": e} for s, kind, e in f[j]] for f in found], struct) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "base", "spans"])

    span = "array<struct<start:int,kind:string,end:int>>"
    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kinds}, base {span}, spans {span}")


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with each span of personal data in the text replaced by its kind in brackets; overlapping spans become one, named by the first. A null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, doc_id))
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                texts = part.column(place).to_pylist()
                out = []
                for t, (_, spans) in zip(texts, find([t or "" for t in texts], shared.value), strict=True):
                    made, at, over = [], 0, 0
                    for s, kind, e in spans:
                        if s >= over:
                            made += [t[max(at, over) : s], f"[{KINDS[kind].upper()}]"]
                        over = max(over, e)
                        at = over
                    out.append(t if not spans else "".join(made) + t[over:])
                cols = list(part.columns)
                cols[place] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
