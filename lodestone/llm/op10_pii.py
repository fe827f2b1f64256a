"""Op 10: personal data by gradient boosting over candidate spans.

Base rules find e-mail addresses, IPv4 addresses, card and phone numbers; their spans always stay. Generators of high
recall propose further spans that may overlap (all group-aligned parts of 7 to 19 digits of each digit run with any
separators, also beside a base span; addresses with plain or defanged dots, e-mail plain or spelt out).
Boosted trees score each from its format and the words before it; per kind a threshold, calibrated on examples held back,
selects. A selected span that overlaps a base span or a better one goes.

The trees are trained here on generated examples, with a fixed seed, in about a second. Offsets are code points, ends
exclusive. Null text: empty, no spans. A null doc_id keeps its row, and so do repeated rows and ids. Very long texts are read
whole, candidates scored in blocks. Candidates of equal score: the longest first. An empty table gives an empty table. Other
columns may have any names.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
SEED = 11
#: Candidates that are scored at a time.
CHUNK = 1 << 12

Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits can't match where the run's own start doesn't, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: a run before an @ either matches from its start or not at all."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # what follows can't reach back over this @
            at = text.find("@", floor)
    return found


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15] if "+" in text else [],
    }


# --- candidates -------------------------------------------------------------------------------------------------------

RUN = re.compile(r"[0-9]+(?:[ ()./-]{1,3}[0-9]+)*")
GROUP = re.compile("[0-9]+")
NEAR_BEFORE, NEAR_AFTER = re.compile(r"[0-9][ ()./-]{1,3}$"), re.compile(r"[ ()./-]{1,3}[0-9]")
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.| ?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\bdot\b) ?)[0-9]{1,3}){3}(?![0-9])", re.I)
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s{0,2}(?:[\[({]\s?(?:at|AT|@)\s?[\])}]|\s(?:at|AT)\s|@)\s{0,2}[A-Za-z0-9-]{1,63}(?:\s{0,2}(?:[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\s(?:dot|DOT)\s|\.)\s{0,2}[A-Za-z0-9-]{2,24}){1,4}")
#: Words that speak for or against a kind when they stand before a span.
CUES = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "appelez", "llame"),
    "none": ("version", "page", "isbn", "id", "token", "order", "item", "year", "section", "price", "total"),
}
BEFORE = 28


def candidates(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            start -= start > 0 and text[start - 1] == "("
            n, ends = 0, []
            for a, b in groups[i : i + 19]:
                n += b - a
                if n > 19:
                    break
                ends.append((n, b))
            for n, end in reversed(ends):  # of equal scores the longest goes first
                if 12 <= n <= 19:
                    found.append(("card", start, end))
                if 7 <= n <= 15:
                    found.append(("phone", start, end))
    found += [("ip", *m.span()) for m in DOTTED.finditer(text)]
    low = text.lower()
    if "dot" in low or "@" in text or "[." in text or "(." in text:
        found += [("email", *m.span()) for m in SPELT.finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before = text[start:end], text[max(0, start - BEFORE) : start].lower()
    digits = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    words = re.findall(r"[^\W\d_]+", before)
    cue = lambda k: float(any(w.startswith(c) if len(c) > 2 else w == c for w in words[-4:] for c in CUES[k]))
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(")), float(s.count("/")),
        float(luhn(digits)) if digits else 0.0,
        float(all(int(g) <= 255 for g in groups)) if groups else 0.0,
        float(bool(re.search(r"[\[({]\s?(?:at|dot|@|\.)", s, re.I))), float("@" in s),
        float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end : end + 1].isalnum()),
        float(text[max(0, start - 2) : start].strip().endswith((":", "=", "#"))), float("+" in text[max(0, start - 2) : start]),
        float(len(groups[0])) if groups else 0.0, float(len(groups[-1])) if groups else 0.0,
        float(bool(NEAR_BEFORE.search(text, max(0, start - 4), start))), float(bool(NEAR_AFTER.match(text, end))),
        *(cue(k) for k in CUES),
    ]


# --- boosted trees ----------------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of depth 3 as heaps: feature, cut, and the values of eight leaves."""

    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += v[node - 7]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, l2: float = 1.0) -> Boosted:
    """Newton boosting on the logistic loss with exact cuts at up to 16 quantiles of each feature."""
    p = y.mean()
    model = Boosted(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 16))) for j in range(x.shape[1])]
    z = np.full(len(y), model.start)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, leaf = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
        members = {0: np.arange(len(y))}
        for node in range(7):
            own = members.get(node, np.zeros(0, np.int64))
            best = (1e-6, 0, np.inf)
            if len(own) > 8:
                gs, hs = g[own], h[own]
                G, H = gs.sum(), hs.sum()
                for j, at in enumerate(cuts):
                    right = x[own, j][:, None] > at[None, :]
                    gr, hr = gs @ right, hs @ right
                    gain = gr**2 / (hr + l2) + (G - gr) ** 2 / (H - hr + l2) - G**2 / (H + l2)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(at[k]))
            feature[node], cut[node] = best[1], best[2]
            right = x[own, best[1]] > best[2]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        for k in range(8):
            own = members[7 + k]
            if len(own):
                leaf[k] = -rate * g[own].sum() / (h[own].sum() + l2)
                z[own] += leaf[k]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def example(rng: random.Random) -> tuple[str, str, int, int, int] | None:
    """A generated text, the kind of a candidate in it, its span, and whether it is personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeiourstnlmdk") for _ in range(rng.randint(2, 9)))
    kind, good = rng.choice(KINDS), rng.random() < 0.5
    cue = rng.choice(CUES[kind]) + rng.choice([": ", " ", " is ", "="]) if good else rng.choice([w() + " ", rng.choice(CUES["none"]) + " ", w() + ", "])
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        s = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(7)}"]) if good else rng.choice([d(rng.randint(7, 15)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)}.{d(2)}.{d(5)}", f"{d(4)}/{d(4)}"])
    elif kind == "card":
        s = " ".join(d(4) for _ in range(4)) if rng.random() < 0.5 else d(rng.randint(13, 19))
        if good:
            s = rng.choice(["/", ".", "  "]).join(d(4) for _ in range(4))
    elif kind == "ip":
        s = rng.choice(["[.]", "(.)", "[dot]", " [.] ", "{.}", " dot "]).join(str(rng.randint(0, 255) if good else rng.randint(256, 999)) for _ in range(4))
    else:
        at, dot = (rng.choice([" [at] ", "(at)", " (at) ", "[at]", " at ", " AT "]), rng.choice([" [dot] ", "(dot)", "[dot]", " dot ", " DOT "])) if good else (rng.choice([" at ", "@", " AT "]), rng.choice([". ", ".", " . "]))
        s = f"{w()}{at}{w()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'io'] if good else [w(), w()])}"
    text = f"{' '.join(w() for _ in range(rng.randint(0, 5)))} {cue}{s}{rng.choice(['.', ' ', ', ', ''])} {w()}"
    own = [c for c in candidates(text) if c[0] == kind]
    at = text.find(s)
    hit = [c for c in own if c[1] <= at + 1 and c[2] >= at + len(s) - 1]
    return (text, kind, hit[0][1], hit[0][2], int(good)) if hit else None


def neighbours(rng: random.Random) -> list[tuple[str, str, int, int, int]]:
    """A generated text with numbers beside each other: all candidates of its run, and whether each is a whole card or phone."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeiourstnlmdk") for _ in range(rng.randint(2, 9)))
    text, good = f"{w()} {rng.choice([w(), rng.choice(CUES['phone']), rng.choice(CUES['card'])])} ", set()
    common = rng.choice(["phone", "card", "other"])
    for k in range(rng.randint(2, 3)):
        text += rng.choice([" ", " / ", " - "]) if k else ""
        kind = common if rng.random() < 0.7 else rng.choice(["phone", "card", "other"])
        if kind == "phone":
            a, b, c = d(3), d(3), d(4)
            s = rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
        elif kind == "card":
            s = d(15)
            s += next(x for x in "0123456789" if luhn(s + x))
            s = rng.choice([" ", "-"]).join(s[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.7 else s
        else:
            s = rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), d(rng.randint(1, 9)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", "".join(rng.choice("0123456789" * 5 + "abcdef") for _ in range(rng.randint(16, 40)))])
        if kind != "other":
            good.add((kind, len(text) + s.startswith("+"), len(text) + len(s)))
        text += s
    text += f" {w()}"
    base = [x for v in base_spans(text).values() for x in v]
    return [(text, *c, int(c in good)) for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in base)]


def train(n: int = 3000, seed: int = SEED) -> Boosted:
    rng = random.Random(seed)
    rows = [e for e in (example(rng) for _ in range(n)) if e]
    rows += [e for _ in range(n // 5) for e in neighbours(rng)]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([g for *_, g in rows], float)
    held = np.arange(len(y)) % 3 == 2
    model = boost(x[~held], y[~held])
    p = model.probability(x[held])
    for i, kind in enumerate(KINDS):  # the lowest threshold at which the held examples reach the precision
        own = x[held][:, 0] == i
        order = np.argsort(-p[own], kind="stable")
        hits = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(hits >= PRECISION)
        model.thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model


def all_spans(text: str, model: Boosted) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with those that the trees add."""
    base = base_spans(text)
    found = {k: list(v) for k, v in base.items()}
    proposed = candidates(text)
    if not proposed:
        return base, found
    taken = sorted(s for v in base.values() for s in v)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []

    def free(start: int, end: int) -> bool:
        k = bisect_right(starts, end - 1)
        return not k or reach[k - 1] <= start

    proposed = [c for c in proposed if free(c[1], c[2])]
    if not proposed:
        return base, found
    scored: list[tuple[float, int]] = []
    for at in range(0, len(proposed), CHUNK):
        p = model.probability(np.array([features(text, *c) for c in proposed[at : at + CHUNK]]))
        scored += [(-float(x), at + i) for i, x in enumerate(p) if x >= model.thresholds[proposed[at + i][0]]]
    added: list[Span] = []  # ascending, apart
    for _, i in sorted(scored):
        kind, start, end = proposed[i]
        k = bisect_right(added, (start, end))
        if (not k or added[k - 1][1] <= start) and (k == len(added) or end <= added[k][0]):
            added.insert(k, (start, end))
            found[kind].append((start, end))
    return base, {k: sorted(v) for k, v in found.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by [KIND]; of overlapping spans the union is replaced once."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, counts of base spans, base_sha256, spans, n_spans (all); with `keep` also `redacted`, the text with each span replaced, and
    `document`, a struct of docs' columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train())  # some forty small trees
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[F.struct(*(docs[c] for c in docs.columns)).alias("document")] * keep)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_spans bigint"
    schema += f", redacted string, document {dict(chosen.dtypes)['document']}" if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = texts(batch)
            got = [all_spans(t, shared.value) for t in rows]
            columns = [batch.column(0), *(pa.array([len(b[k]) for b, _ in got], pa.int64()) for k in KINDS)]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([joined(s) for _, s in got], pa.string()), pa.array([sum(map(len, s.values())) for _, s in got], pa.int64())]
            if keep:
                null = batch.column(1).is_null().to_pylist()
                columns += [pa.array([None if n else redact(t, s) for t, (_, s), n in zip(rows, got, null, strict=True)], pa.string()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", *["redacted", "document"] * keep])

    return chosen.mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with their columns, personal data replaced in the text."""
    found = pii(docs, id_col, text_col, keep=True)
    return found.select(*(F.col("redacted").alias(c) if c == text_col else F.col("document").getField(c).alias(c) for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))
