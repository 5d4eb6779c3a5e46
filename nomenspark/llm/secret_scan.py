"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its surroundings.

The patterns give the base findings, which always stay. A candidate is any run of 16 or more token characters, whatever they
are, any run of 8 or more after a word that names a credential, and any base finding; the network, in numpy, reads each with
the text around it. It scores the base findings, and adds those others that it scores above its threshold and that no base
finding overlaps. It is trained here on labelled findings that a seeded generator writes: a bounded number of rows, a
parameter. A part held out calibrates its scores (a logistic fit) and sets the threshold: the highest at which the held-out
recall is at least min_recall, where a secret that is no candidate counts as missed.

No shuffle; each text is scanned whole in its row. The model, some 30 KB, goes with the tasks.

Defined results: a null or empty text has no findings; very long texts and candidates are read whole; repeated rows each
get their row; an empty table gives none; other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

KINDS = ("assign", "access", "hex", "network")
#: Letters of the names match in either case, within ASCII only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs that are too short could not pass, and a shorter run inside one can't either.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Long runs, and shorter ones after words that name credentials.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
AFTER_NAME = re.compile(
    r"""(?<![A-Za-z])(?i:pwd|pass|passwd|password|passcode|passphrase|credentials?|creds?|bearer|auth|authorization|login|pin|key|apikey|secret|token)["']?(?:\x20*[:=]\x20*|\x20+(?:is\x20+)?)["']?([A-Za-z0-9+/_.=!@$%^&*~-]{8,})""",
    re.ASCII,
)
#: What an AFTER_NAME needs to hold; texts without any of them are not searched.
STEMS = re.compile(r"(?i:pwd|pass|cred|bearer|auth|login|pin|key|secret|token)")
AROUND, WIDTH, FILTERS, DIM = 24, 5, 24, 12
CODES = 99  # 0 padding, 1 to 95 printable ASCII, 96 line ends, 97 other controls, 98 the rest


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' findings, sorted."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates that are no base findings, sorted; none overlaps another."""
    spans = [m.span() for m in LONG_RUN.finditer(text)]
    if STEMS.search(text):
        spans += [m.span(1) for m in AFTER_NAME.finditer(text)]
        spans.sort(key=lambda x: (x[0], -x[1]))
        joined: list[tuple[int, int]] = []
        for a, b in spans:  # a run that reaches into another one becomes part of it
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        return joined
    return spans


# ---- the network


def codes(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(p), 98, np.int64)
    out[p < 127] = 97
    printable = (p >= 32) & (p < 127)
    out[printable] = p[printable] - 31
    out[(p == 10) | (p == 13)] = 96
    return out


def windows(cases: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, part) of texts with a candidate's start and end: part is 0 outside, 1 in the candidate, 2 around it."""
    cut = [(t[max(0, a - AROUND) : a], t[a:b], t[b : b + AROUND]) for t, a, b in cases]
    most = max(len(x[1]) for x in cut) + 2 * AROUND
    x, part = np.zeros((len(cut), most), np.int64), np.zeros((len(cut), most), np.int8)
    for i, (before, inside, after) in enumerate(cut):
        whole = codes(before + inside + after)
        at = AROUND - len(before)
        x[i, at : at + len(whole)] = whole
        part[i, at : at + len(whole)] = 2
        part[i, AROUND : AROUND + len(inside)] = 1
    return x, part


@dataclass
class Network:
    """Embedding, one convolution, maxima over the candidate and over its surroundings, mean over the candidate, logistic
    output, calibration and threshold."""

    embed: np.ndarray  # CODES x DIM
    filters: np.ndarray  # WIDTH * (DIM + 1) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS + 1
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def layers(self, x: np.ndarray, part: np.ndarray):
        inside = (part == 1).astype(np.float64)
        e = np.concatenate([self.embed[x] * (part > 0)[..., None], inside[..., None]], axis=2)
        padded = np.pad(e, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        cols = np.concatenate([padded[:, k : k + x.shape[1]] for k in range(WIDTH)], axis=2)
        act = np.maximum(cols @ self.filters + self.bias, 0)
        inner, outer = act * inside[..., None], act * (part == 2)[..., None]
        n = inside.sum(1)[:, None]
        feats = np.concatenate([inner.max(1), outer.max(1), inner.sum(1) / n, np.ones((len(x), 1))], axis=1)
        return cols, act, inner, outer, inside, n, feats

    def logits(self, cases: list[tuple[str, int, int]], cells: int = 200_000) -> np.ndarray:
        """Raw scores; cases of like length go together, about cells positions at a time."""
        out, order, at = np.empty(len(cases)), sorted(range(len(cases)), key=lambda i: cases[i][2] - cases[i][1]), 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * (cases[order[to]][2] - cases[order[to]][1] + 2 * AROUND) <= cells:
                to += 1
            own = order[at:to]
            out[own] = self.layers(*windows([cases[i] for i in own]))[-1] @ self.out
            at = to
        return out

    def scores(self, cases: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(cases) + self.shift, -50, 50))) if cases else np.empty(0)

    def gradients(self, x: np.ndarray, part: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, act, inner, outer, inside, n, feats = self.layers(x, part)
        p = 1 / (1 + np.exp(-np.clip(feats @ self.out, -50, 50)))
        d = (p - y) / len(y)
        back = d[:, None] * self.out[None, :-1]
        rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        g = np.zeros_like(act)
        g[rows, inner.argmax(1), f] += back[:, :FILTERS] * (inner.max(1) > 0)
        g[rows, outer.argmax(1), f] += back[:, FILTERS : 2 * FILTERS] * (outer.max(1) > 0)
        g += inside[..., None] * (back[:, 2 * FILTERS :] / n)[:, None, :]
        g *= act > 0
        into = g @ self.filters.T
        embed = np.zeros((x.shape[0], x.shape[1] + WIDTH - 1, DIM))
        for k in range(WIDTH):
            embed[:, k : k + x.shape[1]] += into[..., k * (DIM + 1) : k * (DIM + 1) + DIM]
        embed = embed[:, WIDTH // 2 : WIDTH // 2 + x.shape[1]] * (part > 0)[..., None]
        total = np.zeros_like(self.embed)
        np.add.at(total, x.ravel(), embed.reshape(-1, DIM))
        return {"embed": total, "filters": np.tensordot(cols, g, ([0, 1], [0, 1])), "bias": g.sum((0, 1)), "out": feats.T @ d}


def fit(findings: list[tuple[str, int, int, int]], seed: int, rounds: int = 6, batch: int = 64, min_recall: float = 0.95) -> Network:
    """A network for labelled findings (text, start, end, 1 if a secret). Every fifth is held out for calibration. One whose
    end is its start is no candidate: it is not learned from, and held-out ones count as missed."""
    r = np.random.default_rng(seed)
    net = Network(r.normal(0, 0.3, (CODES, DIM)), r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * (DIM + 1), FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 3 * FILTERS + 1))
    held = [f for i, f in enumerate(findings) if i % 5 == 4 and f[1] < f[2]]
    train = [f for i, f in enumerate(findings) if i % 5 != 4 and f[1] < f[2]]
    missed = sum(f[3] for i, f in enumerate(findings) if i % 5 == 4 and f[1] == f[2])
    mean = {k: np.zeros_like(getattr(net, k)) for k in ("embed", "filters", "bias", "out")}
    square, step = {k: v.copy() for k, v in mean.items()}, 0
    for _ in range(rounds):
        order = r.permutation(len(train))
        for at in range(0, len(order), batch):
            own = [train[i] for i in order[at : at + batch]]
            grads, step = net.gradients(*windows([f[:3] for f in own]), np.array([f[3] for f in own], float)), step + 1
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                rate = 0.004 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - rate)
    raw, y = net.logits([f[:3] for f in held]), np.array([f[3] for f in held], float)
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -50, 50)))
        a, b = a - 0.01 * (((p - y) * raw).mean() + 1e-3 * (a - 1)), b - 0.1 * (p - y).mean()
    net.scale, net.shift = float(a), float(b)
    found = np.sort(np.concatenate([np.zeros(missed), net.scores([f[:3] for f in held if f[3]])]))
    net.threshold = 0.5
    if len(found):  # the highest that keeps min_recall, and not above 0.5 for nothing
        net.threshold = float(found[int((1 - min_recall) * len(found))])
    return net


# ---- labelled findings

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"
_NAMES = (
    "client_secret", "auth", "Authorization: Bearer", "pwd", "credential", "access_key", "private_key", "key", "apikey", "pass", "bearer", "x-auth", "login",
    "passphrase", "passcode", "DB_PASS", "creds", "pin",
)
#: Parts of long words, as natural languages join them.
_ONSETS = ("", "", "b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "ch", "dr", "fr", "gr", "kr", "pf", "ph", "pl", "pr", "sch", "sp", "st", "str", "th", "tr", "wh", "zw")
_NUCLEI = ("a", "e", "e", "i", "o", "u", "ai", "au", "ea", "ee", "ei", "eu", "ie", "io", "oo", "ou", "y")
_CODAS = ("", "", "", "n", "r", "s", "t", "l", "m", "nd", "ng", "nt", "ch", "cht", "ck", "ld", "lich", "ment", "ness", "rt", "sch", "ss", "st", "th", "tion", "tz", "keit", "heit", "ung")
_PLAIN = ("version", "file", "path", "build", "page", "id", "name", "ref", "see", "http", "image", "chapter", "order", "sha of release", "isbn", "the", "a")


def labelled_findings(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, 1 if a secret), about half of them secrets: random keys of several alphabets
    and lengths after names of credentials or, when long, alone in prose, against identifiers, paths, dates, numbers,
    slugs, long words, and words after names of credentials. start is end for a secret that is no candidate."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    word = lambda: "".join(pick(_CONSONANTS) + pick(_VOWELS) for _ in range(int(r.integers(1, 5))))
    prose = lambda: " ".join(word() for _ in range(int(r.integers(0, 8))))
    spoken = lambda: "".join(pick(_ONSETS) + pick(_NUCLEI) + pick(_CODAS) for _ in range(int(r.integers(2, 8))))
    run = lambda alphabet, lo, hi: "".join(pick(alphabet) for _ in range(int(r.integers(lo, hi))))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()

    def secret() -> tuple[str, bool]:
        """A key, and whether it is short."""
        kind = r.integers(9)
        if kind == 0:
            return run("0123456789abcdef", 24, 65), False
        if kind == 1:
            return run(lower + upper + digits + "+/", 20, 65) + pick(("", "=", "==")), False
        if kind == 2:
            return run(lower + upper + digits, 18, 50), False
        if kind == 3:
            return pick(("sk-", "ghp_", "xoxb-", "pk_live_", "AIza", "glpat-")) + run(lower + upper + digits + "_-", 20, 42), False
        if kind == 4:
            return run(upper + digits, 18, 40), False
        if kind == 5:
            return "eyJ" + run(lower + upper + digits + "_-", 30, 80), False
        if kind == 6:
            return run(pick((lower + upper, lower, upper)), 20, 40), False
        return run(lower + upper + digits + pick(("", "!@$%^&*", "_-")), 6, 16), True

    def harmless() -> str:
        kind = r.integers(18)
        if kind >= 14:
            return pick((spoken(), spoken().capitalize(), spoken().upper()))
        if kind == 12:
            return spoken() + pick("!@$%^&*~-") * int(r.integers(1, 6))
        if kind == 13:
            return pick("-_/").join(spoken() for _ in range(int(r.integers(2, 4))))
        if kind == 0:
            return "-".join([word(), word(), word(), run(digits, 1, 5)]) + word()
        if kind == 1:
            return "/".join([word() + word(), word(), word() + run(digits, 1, 4), word()])
        if kind == 2:
            return "_".join([word(), word(), word(), "v" + run(digits, 1, 3), word()])
        if kind == 3:
            return f"{run(digits, 4, 5)}-{run(digits, 2, 3)}-{run(digits, 2, 3)}T{run(digits, 6, 7)}Z"
        if kind == 4:
            return pick(lower) * int(r.integers(8, 30)) + pick(digits) * int(r.integers(8, 30))
        if kind == 5:
            return (word() + word() + word()).capitalize() + word() + word() + run(digits, 1, 4)
        if kind == 6:
            return run(digits, 14, 30) + pick((*lower, ""))
        if kind == 7:
            return "=".join([word() + word(), word() + word() + run(digits, 1, 3)]) + "=" * 8
        if kind == 8:
            return pick("=-_") * int(r.integers(16, 80))
        if kind == 9:
            return "".join(word().capitalize() for _ in range(int(r.integers(3, 7))))
        if kind == 10:
            return "_".join(word().upper() for _ in range(int(r.integers(3, 6))))
        return "".join(word() for _ in range(int(r.integers(2, 7))))

    out = []
    while len(out) < n:
        label, short = int(r.integers(2)), False
        if label:
            body, short = secret()
        else:
            body = harmless()
        named = short or (r.random() < 0.7) == bool(label)
        names = _NAMES if named else _PLAIN
        between = pick((" = ", ": ", "=", ' = "', " "))
        lead = prose() + " " + (pick(names) + between if short else pick((pick(names) + between, word() + " ", "")))
        text = lead + body + pick(("", '"', " ", "\n", ",", ". ")) + prose()
        own = [s for s in candidates(text) if s[0] < len(lead) + len(body) and s[1] > len(lead)]
        if own:
            out.append((text, *max(own, key=lambda s: s[1] - s[0]), label))
        elif label:
            out.append((text, len(lead), len(lead), 1))
    return out


@lru_cache(maxsize=2)
def trained(seed: int = 20260101, rows: int = 12000, min_recall: float = 0.95) -> Network:
    """The network for rows generated findings."""
    return fit(labelled_findings(seed, rows), seed, min_recall=min_recall)


# ---- operators


def findings_of(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """Per text (start, kind number, end, score) by start and kind."""
    base = [base_findings(t) for t in texts]
    cases, kinds = [], []
    for i, (t, found) in enumerate(zip(texts, base, strict=True)):
        cases += [(i, a, b) for a, _, b in found]
        kinds += [k for _, k, _ in found]
        at, reach = 0, 0  # base findings are sorted by start; reach is the furthest end of those before
        for a, b in candidates(t):
            while at < len(found) and found[at][0] < b:
                at, reach = at + 1, max(reach, found[at][2])
            if reach <= a:
                cases.append((i, a, b))
                kinds.append(len(KINDS) - 1)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for (i, a, b), k, s in zip(cases, kinds, net.scores([(texts[i], a, b) for i, a, b in cases]), strict=True):
        if k < len(KINDS) - 1 or s >= net.threshold:
            out[i].append((a, k, b, float(s)))
    return [sorted(x) for x in out]


FINDINGS = "array<struct<kind:string,start:int,end:int,score:double>>"


def scan(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and findings (kind, start, end in code points, end exclusive, score), by start and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                found = findings_of(part.column("text").to_pylist(), net)
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in x] for x in found]
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "findings": pa.array(rows, kind)})

    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, findings {FINDINGS}").withColumnRenamed("key", key)


def mask(text: str, spans: list[tuple[int, int]], by: str) -> str:
    """The text with each run of overlapping spans replaced."""
    out, at, end = [], 0, 0
    for a, b in sorted(spans):
        if a >= end or not out:
            out += [text[at:a], by]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, net: Network, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """df with its texts' findings masked; null texts stay null, and n_chars, where there is one, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = findings_of([t or "" for t in texts], net)
                new = [t and mask(t, [(a, b) for a, _, b, _ in x], by) for t, x in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "text": pa.array(new, pa.string())})

    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text).cast("string").alias("text"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    cols = []
    for f in df.schema:
        if f.name == text:
            cols.append(F.col("text").alias(text))
        elif f.name == "n_chars":
            cols.append(F.when(F.col("row.n_chars").isNotNull(), F.length("text").cast(f.dataType)).alias("n_chars"))
        else:
            cols.append(F.col("row")[f.name].alias(f.name))
    return done.select(*cols)
