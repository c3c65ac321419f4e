"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy, by back-propagation through time and the CRF's forward-backward sums, from labelled
spans. A text is cut into overlapping windows; windows of many texts run side by side. Every character's label comes
from the window in which it lies furthest from an edge, and spans are formed on the whole text's labels, so a window
border cuts no span. Spans of the patterns always stay; the network adds spans that touch none of them.

The CRF decodes only windows in which some character could beat label `none` with the best transitions on either
side; for all others the path without spans is provably the best.

Defined results: a null text counts as empty and has no spans; an identifier that is no integer counts as null. Offsets count code points; ends are exclusive. Rows
are independent, so repeated rows, ties and null identifiers get one result each. Extra columns are ignored. Long
texts are read whole, a group of windows at a time.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELS = ("none", *KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Found from each @ outwards, so that the time is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[Span]:
    """Four parts at a time of each maximal run of dotted numbers."""
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                yield "ip", at, end
            at = end + 1


def numbers(kind: str, pattern: re.Pattern, least: int, most: int, text: str) -> Iterator[Span]:
    for found in pattern.finditer(text):
        digits = "".join(DIGIT.findall(found.group()))
        if least <= len(digits) <= most and (kind != "card" or luhn(digits)):
            yield kind, found.start(), found.end()


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    found = list(emails(text))
    if DIGIT.search(text):
        found += addresses(text)
        found += numbers("card", CARD, 13, 19, text)
        if "+" in text:
            found += numbers("phone", PHONE, 9, 15, text)
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The network

SIGNS = 131
NEWLINE = 10


@cache
def signs() -> np.ndarray:
    """Code point to input sign: ASCII as it is, then lower-case letters, other letters, the rest."""
    table = np.full(0x110000, 130, np.uint8)
    table[:128] = np.arange(128)
    for c in range(128, 0x110000):
        if chr(c).isalpha():
            table[c] = 128 if chr(c).islower() else 129
    return table


def encode(text: str) -> np.ndarray:
    return signs()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


@dataclass(frozen=True)
class TagSettings:
    """window, overlap: characters. examples x length: the training text. together: windows run side by side."""

    units: int = 8
    window: int = 512
    overlap: int = 64
    together: int = 768
    length: int = 96
    batch: int = 64
    steps: int = 700
    rate: float = 0.02
    seed: int = 11


class Tagger:
    """Weights: for each direction `sign` (signs x 4 units), `own` (units x 4 units); then `out` (2 units x labels),
    `bias`, and `move` (from label, to label). Gates are ordered in, forget, out, cell."""

    def __init__(self, units: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.units = units
        self.p = {f"{k}{d}": rng.normal(0, s, (n, 4 * units)) for d in "fb" for k, n, s in (("sign", SIGNS, 0.3), ("own", units, 0.3))}
        for d in "fb":
            self.p[f"sign{d}"][:, units : 2 * units] += 1.0
        self.p |= {"out": rng.normal(0, 0.3, (2 * units, len(LABELS))), "bias": np.zeros(len(LABELS)), "move": np.zeros((len(LABELS),) * 2)}
        self.p["bias"][0] = 2.0
        self.p["move"][np.diag_indices(len(LABELS))] = 1.0

    # training: arrays are (time, batch, ...)

    def _run(self, x: np.ndarray, d: str) -> list[tuple]:
        u, own = self.units, self.p[f"own{d}"]
        h = c = np.zeros((x.shape[1], u))
        steps = []
        for row in self.p[f"sign{d}"][x]:
            z = row + h @ own
            gate, cell = 1 / (1 + np.exp(-z[:, : 3 * u])), np.tanh(z[:, 3 * u :])
            before, c = c, gate[:, u : 2 * u] * c + gate[:, :u] * cell
            flat = np.tanh(c)
            steps.append((h, before, gate, cell, flat))
            h = gate[:, 2 * u :] * flat
            steps[-1] += (h,)
        return steps

    def _back(self, x: np.ndarray, d: str, steps: list[tuple], dh_out: np.ndarray, grad: dict) -> None:
        u, own = self.units, self.p[f"own{d}"]
        dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
        dz = np.empty((*x.shape, 4 * u))
        for t in range(len(x) - 1, -1, -1):
            prev, before, gate, cell, flat, _ = steps[t]
            i, f, o = gate[:, :u], gate[:, u : 2 * u], gate[:, 2 * u :]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - flat**2)
            dz[t, :, :u] = dc * cell * i * (1 - i)
            dz[t, :, u : 2 * u] = dc * before * f * (1 - f)
            dz[t, :, 2 * u : 3 * u] = dh * flat * o * (1 - o)
            dz[t, :, 3 * u :] = dc * i * (1 - cell**2)
            grad[f"own{d}"] += prev.T @ dz[t]
            dh, dc = dz[t] @ own.T, dc * f
        np.add.at(grad[f"sign{d}"], x.ravel(), dz.reshape(-1, 4 * u))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the label paths y for the signs x, both (time, batch), and its gradient."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        ahead, back = self._run(x, "f"), self._run(x[::-1], "b")
        h = np.concatenate([np.stack([s[5] for s in ahead]), np.stack([s[5] for s in back])[::-1]], 2)
        e, move = h @ self.p["out"] + self.p["bias"], self.p["move"]
        n, b, k = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = e[t] + logsum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = logsum(alpha[-1], 1)
        at = np.arange(b)
        best = sum(e[t, at, y[t]] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n))
        de = np.exp(alpha + beta - total[None, :, None])
        de[np.arange(n)[:, None], at, y] -= 1
        pair = alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        grad["move"] = np.exp(pair).sum((0, 1))
        np.subtract.at(grad["move"], (y[:-1].ravel(), y[1:].ravel()), 1)
        grad["out"] = np.tensordot(h, de, ((0, 1), (0, 1)))
        grad["bias"] = de.sum((0, 1))
        dh = de @ self.p["out"].T
        self._back(x, "f", ahead, dh[:, :, : self.units], grad)
        self._back(x[::-1], "b", back, dh[::-1, :, self.units :], grad)
        return float((total - best).mean()), {name: g / (b * n) for name, g in grad.items()}

    # use: arrays are (time, units or labels, windows); windows are sorted by their size, and what lies beyond a
    # window's size is never read, so its labels do not depend on the windows beside it

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label scores (time, labels, windows) for signs (time, windows)."""
        u = self.units
        n, b = x.shape
        starts = np.searchsorted(sizes, np.arange(n), "right")
        half = np.r_[np.full(3 * u, 0.5), np.ones(u)]
        found = np.empty((n, len(LABELS), b), np.float32)
        found[:] = self.p["bias"].astype(np.float32)[:, None]
        for d, turns in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            sign = np.ascontiguousarray((self.p[f"sign{d}"] * half).T.astype(np.float32))
            own = np.ascontiguousarray((self.p[f"own{d}"] * half).T.astype(np.float32))
            out = np.ascontiguousarray(self.p["out"][slice(0, u) if d == "f" else slice(u, 2 * u)].T.astype(np.float32))
            every_h, every_c = np.zeros((u, b), np.float32), np.zeros((u, b), np.float32)
            wide, first = None, -1
            for t in turns:
                if first != starts[t]:  # windows begin, or end, here
                    if wide is not None:
                        every_h[:, first:], every_c[:, first:] = h, c
                    first, wide = starts[t], b - starts[t]
                    h, c = np.ascontiguousarray(every_h[:, first:]), np.ascontiguousarray(every_c[:, first:])
                    z, y, e = (np.empty((k, wide), np.float32) for k in (4 * u, 4 * u, len(LABELS)))
                np.take(sign, x[t, first:], axis=1, out=z, mode="clip")
                np.matmul(own, h, out=y)
                z += y
                np.tanh(z, out=z)
                gates = z[: 3 * u]
                gates *= 0.5
                gates += 0.5
                c *= z[u : 2 * u]
                z[:u] *= z[3 * u :]
                c += z[:u]
                np.tanh(c, out=h)
                h *= z[2 * u : 3 * u]
                np.matmul(out, h, out=e)
                found[t, :, first:] += e
        return found

    def open_windows(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Windows that could hold a span. Against the path of `none` alone, a place with another label gains its own
        score, at most the best move into the label, and the move back if that pays; the first place is entered by no
        move. Where no place gains anything, the path of `none` is the best."""
        move = self.p["move"]
        back = np.maximum(0, move[1:, 0] - move[0, 0])
        gain = np.repeat((move[:, 1:].max(0) - move[0, 0] + back)[None], len(e), 0)
        gain[0] = back
        above = (e[:, 1:] + gain.astype(np.float32)[:, :, None]).max(1) > e[:, 0]
        return np.flatnonzero((above & (np.arange(len(e))[:, None] < sizes)).any(0))

    def decode(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best label paths (time, windows); `none` beyond a window's size."""
        n, k, b = e.shape
        move = self.p["move"].astype(np.float32)
        came = np.empty((n, k, b), np.uint8)
        best, own, at = e[0], e[0].argmax(0), np.arange(b)
        for t in range(1, n):
            every = best[:, None, :] + move[:, :, None]
            came[t] = every.argmax(0)
            best = every.max(0) + e[t]
            own = np.where(sizes > t, best.argmax(0), own)
        path = np.zeros((n, b), np.uint8)
        for t in range(n - 1, -1, -1):
            inside = sizes > t
            path[t] = np.where(inside, own, 0)
            if t:
                own = np.where(inside, came[t, own, at], own)
        return path


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit(texts: list[str], spans: list[list[Span]], settings: TagSettings = TagSettings()) -> Tagger:
    """Trains on labelled texts, cut or filled to settings.length, with Adam on shuffled batches."""
    x = np.full((len(texts), settings.length), NEWLINE, np.uint8)
    y = np.zeros(x.shape, np.int64)
    for i, (text, own) in enumerate(zip(texts, spans, strict=True)):
        row = encode(text)[: settings.length]
        x[i, : len(row)] = row
        for kind, a, b in own:
            y[i, a:b] = LABELS.index(kind)
    rng = np.random.default_rng(settings.seed)
    tagger = Tagger(settings.units, settings.seed)
    first, second = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2))
    for step in range(1, settings.steps + 1):
        pick = rng.integers(0, len(x), settings.batch)
        _, grad = tagger.gradient(x[pick].T, y[pick].T)
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        rate = settings.rate * min(1, 2 * (1 - step / (settings.steps + 1))) * min(1, 1 / (norm + 1e-9))
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g**2 - second[k])
            tagger.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return tagger


def labelled_examples(n: int, length: int, seed: int) -> tuple[list[str], list[list[Span]]]:
    """Invented prose, tables, shouting and numbers, some with personal data of the five kinds."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(k))
    vowels, others = "aeiouyéèêüöäíóáàç", "bcdfghjklmnpqrstvwxzñßç"

    def word() -> str:
        own = "".join(rng.choice(others) * rng.randint(0, 2) + rng.choice(vowels) for _ in range(rng.randint(1, 4))) + rng.choice(others) * rng.randint(0, 1)
        form = rng.random()
        return own.capitalize() if form < 0.1 else own.upper() if form < 0.15 else own

    def plain() -> str:
        form = rng.random()
        if form < 0.90:
            return word() + rng.choice(["", "", "", "", ",", ".", ".\n", ";", " |", "!!", "###", "$$$", "%%%", "&&&", "***", ":", "?"])
        if form < 0.97:
            return rng.choice([digits(rng.randint(1, 11)), f"{digits(2)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"19{digits(2)}", f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"${digits(3)}.{digits(2)}", f"+{digits(2)}", f"{digits(3)}%", f"{digits(1)},{digits(3)}"])
        return rng.choice([f"({word()})", f'"{word()}"', f"{word()}.{word()}", f"@{word()}", f"{word()}-{word()}", f"http://{word()}/{word()}", "version 3", "Version 2.0.", "4.0.", f'{word()} = "{word()}"'])

    def card() -> str:
        own = digits(rng.choice([12, 14, 15, 15, 15, 18]))
        own += next(d for d in "0123456789" if luhn(own + d))
        cut = rng.choice(["", "", " ", "-"])
        return cut.join(own[i : i + 4] for i in range(0, len(own), 4))

    def private() -> tuple[str, str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            return kind, "", rng.choice([word().lower(), word() + "." + word(), word() + digits(2), "." + digits(2), word() + "." + digits(2)]) + "@" + rng.choice([word().lower(), "mail" + digits(1), word().lower() + "." + word().lower()]) + rng.choice([".com", ".org", ".example.com", ".de", ".net"])
        if kind == "ip":
            return kind, "", ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, "", card()
        if kind == "phone":
            return kind, "", rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)}-{digits(3)}-{digits(3)}-{digits(3)}", f"+{digits(11)}"])
        lead = rng.choice(["token = \"", "key = \"", "secret: ", "password=", "api_key: ", "token: "])
        return kind, lead, rng.choice([letters(40, "0123456789abcdef"), letters(32, "0123456789abcdef"), letters(24, "abcdefghijABCDEFGHIJ0123456789")])

    texts, spans = [], []
    for _ in range(n):
        text, own = "", []
        while len(text) < length:
            if rng.random() < 0.09:
                kind, lead, value = private()
                a = len(text) + len(lead)
                if a + len(value) > length:
                    break
                own.append((kind, a, a + len(value)))
                text += lead + value + ('"' if lead.endswith('"') else "") + rng.choice([" ", " ", ". ", "\n", ", ", "### "])
            else:
                text += plain() + rng.choice([" ", " ", " ", "\n"])
        texts.append(text[:length])
        spans.append(own)
    return texts, spans


WEIGHTS = Path(__file__).with_name("tagger.npz")


def trained(settings: TagSettings = TagSettings()) -> Tagger:
    return fit(*labelled_examples(6000, settings.length, settings.seed), settings)


@cache
def default_tagger(settings: TagSettings = TagSettings()) -> Tagger:
    """The tagger that `trained` gives for the default settings, from the file that `python -m maskwright.llm.pii_lstm`
    writes; with other settings, or without that file, it is trained now."""
    if settings != TagSettings() or not WEIGHTS.exists():
        return trained(settings)
    tagger = Tagger(settings.units, settings.seed)
    with np.load(WEIGHTS) as kept:
        tagger.p = {k: kept[k].astype(float) for k in tagger.p}
    return tagger


def windows(size: int, settings: TagSettings) -> list[tuple[int, int]]:
    """Starts and ends of the windows of a text of so many characters; none for an empty one."""
    step = settings.window - settings.overlap
    return [(a, min(a + settings.window, size)) for a in range(0, max(size - settings.overlap, min(size, 1)), step)]


def tag(texts: list[str], tagger: Tagger, settings: TagSettings = TagSettings()) -> list[list[Span]]:
    """The network's spans of each text, by start."""
    flat = encode("".join(texts))
    base = np.cumsum([0, *map(len, texts)])
    every = [(b - a, i, a, b) for i, t in enumerate(texts) for a, b in windows(len(t), settings)]
    every.sort()
    marked: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for at in range(0, len(every), settings.together):
        own = every[at : at + settings.together]
        x = np.full((own[-1][0], len(own)), NEWLINE, np.uint8)
        for j, (n, i, a, b) in enumerate(own):
            x[:n, j] = flat[base[i] + a : base[i] + b]
        sizes = np.array([n for n, *_ in own])
        e = tagger.scores(x, sizes)
        few = tagger.open_windows(e, sizes)
        if len(few):
            paths = tagger.decode(e[:, :, few], sizes[few])
            for j, w in enumerate(few):
                n, i, a, b = own[w]
                if paths[:n, j].any():
                    marked.setdefault(i, []).append((a, b, paths[:n, j]))
    found: list[list[Span]] = [[] for _ in texts]
    margin = settings.overlap // 2
    for i, parts in marked.items():
        labels = np.zeros(len(texts[i]), np.uint8)
        for a, b, path in parts:
            low, high = (a + margin if a else 0), (b - margin if b < len(labels) else b)
            labels[low:high] = path[low - a : high - a]
        edge = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
        found[i] = [(LABELS[labels[a]], int(a), int(b)) for a, b in zip(edge, edge[1:], strict=False) if labels[a]]
    return found


NEEDS = {"email": "@", "ip": ".", "phone": "+"}
LEAST = {"email": 6, "ip": 7, "card": 12, "phone": 8, "secret": 16}


def added(text: str, base: list[Span], tagged: list[Span]) -> list[Span]:
    """Tagged spans, without white space, quotes and full stops at their ends, that touch no pattern's span, are
    long enough for their kind and have the sign it cannot be without."""
    new = []
    for kind, a, b in tagged:
        while a < b and text[a] in " \t\n\"'.,;:":
            a += 1
        while b > a and text[b - 1] in " \t\n\"'.,;:":
            b -= 1
        fits = b - a >= LEAST[kind] and text.find(NEEDS.get(kind, ""), a, b) >= 0
        if fits and not any(a < y and x < b for _, x, y in base):
            new.append((kind, a, b))
    return new


def by_kind(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())]
)


def text_groups(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    own: list[str] = []
    size = 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def find(texts: list[str], tagger: Tagger, settings: TagSettings = TagSettings()) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text, the patterns' spans and all spans."""
    for group in text_groups(texts):
        for text, tagged in zip(group, tag(group, tagger, settings), strict=True):
            base = base_spans(text)
            yield base, by_kind(base + added(text, base, tagged))


def personal_data(documents: DataFrame, tagger: Tagger, settings: TagSettings = TagSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row. No shuffle; the tagger (about 10,000 numbers) is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for i, (base, every) in zip(batch.column(0).to_pylist(), find(texts, shared.value, settings), strict=True):
                row = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
                rows.append({"doc_id": i, **row, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every), "n_spans": len(every)})
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    rows = documents.select(documents[id_col].try_cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(documents: DataFrame, tagger: Tagger, settings: TagSettings = TagSettings(), text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, with personal data in the text replaced; a null text stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = find([t or "" for t in texts], shared.value, settings)
            new = [None if t is None else redacted(t, s) for t, (_, s) in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return documents.mapInArrow(run, documents.schema)


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in trained().p.items()})
