"""Op 2: quality rules.

Base rules count words, symbols, repeated lines and repeated three-word windows. A logistic regression over hashed words and
hashed character n-grams (3 and 4 code points) is trained on labelled rows, its logits are calibrated on rows held back (Platt), and every
text is scored in Arrow batches against a fixed threshold.

A feature is a hashed gram's share of all grams of its family, so a score is a mean of weights: whole texts, one pass.
Training takes TRAIN_ROWS labelled ids at most, those that hash lowest, and of texts under one id the least. Without labels of
both kinds the verdict is true. Null text: no words, so it fails the base rules. A null doc_id keeps its row, and so do
repeated rows and ids. Very long texts are scored whole. An empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, table, texts

TRAIN_ROWS = 1200
BATCH_TEXT = 2 << 20
BUCKETS = 1 << 14
FAMILIES = 3
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SCALE = 20.0
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


@dataclass
class Model:
    weights: np.ndarray  # float32, FAMILIES x BUCKETS
    bias: float
    slope: float
    offset: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -40, 40)))


def base_counts(raw: bytes, n_chars: int, ids: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text whose words have these ids (equal words, equal ids)."""
    word_chars = n_chars - (len(raw) - len(raw.translate(None, WHITE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat = 0
    if len(ids) > 3:
        _, own = np.unique(ids, return_inverse=True)
        size = int(own.max()) + 1
        pair = own[:-1].astype(np.int64) * size + own[1:]
        if size < 1 << 20:
            key = pair[:-1] * size + own[2:]
        else:
            _, pair = np.unique(pair, return_inverse=True)
            key = pair[:-1].astype(np.int64) * size + own[2:]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        if len(counts) < len(key):
            hit = counts[inverse] > 1
            covered = np.zeros(len(ids), bool)
            for k in range(3):
                covered[k : len(ids) - 2 + k] |= hit
            n_repeat = int(covered.sum())
    return word_chars, n_symbols, n_dup, n_repeat


def code_points(text: str, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).astype(np.uint32) if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), "<u4")


def gram_buckets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of three and four code points that begin at each position (too short: empty)."""
    three = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D) if len(x) > 2 else x[:0]
    four = three[:-1] + x[3:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1) if len(x) > 3 else x[:0]
    mix = lambda v: (v ^ v >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(18)
    return mix(three), mix(four)


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def sparse_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features."""
    raw = text.encode()
    grams = [np.fromiter(map(word_bucket, raw.split()), np.int64), *gram_buckets(code_points(text, raw))]
    index, value = [], []
    for k, g in enumerate(grams):
        at, n = np.unique(g, return_counts=True)
        index.append(at.astype(np.int64) + k * BUCKETS)
        value.append(n / max(1, len(g)) * SCALE)
    return np.concatenate(index), np.concatenate(value)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 60, rate: float = 0.3, l2: float = 1e-5) -> Model | None:
    """Logistic regression by Adam over all rows at once; every fourth row is held back for the calibration."""
    held = np.arange(len(labels)) % 4 == 3
    if len(set(labels[~held].tolist())) < 2:
        return None
    flat = np.concatenate([i for i, _ in rows])
    data = np.concatenate([v for _, v in rows])
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    rows.clear()
    n = len(labels)
    y = labels.astype(float)
    w, b = np.zeros(FAMILIES * BUCKETS, np.float32), 0.0
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    balance = np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum())) * (~held)
    for step in range(1, rounds + 1):
        z = np.bincount(of, w[flat] * data, n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance  # none for the rows held back
        gw, gb = np.bincount(flat, g.astype(np.float32)[of] * data, len(w)) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = (w - scale * m / (np.sqrt(v) + 1e-9)).astype(np.float32)
        b -= scale * mb / (np.sqrt(vb) + 1e-9)
    z = np.bincount(of, w[flat] * data, n) + b
    slope, offset = platt(z[held], y[held]) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    return Model(w, b, slope, offset)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a calibrated probability by Newton steps, with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g, h = p - t, p * (1 - p) + 1e-6
        ga, gb = (g * z).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-7:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model | None:
    """A model from at most `limit` labelled rows. Features are made on the executors; `limit` bounds what comes back."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # `limit` rows
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # however often an id repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_TEXT):
            made = [sparse_features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                ["doc_id", "quality", "at", "value"],
            )

    found = sample.select("doc_id", "text", "quality").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, at binary, value binary").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.at))
    labels_of = np.array([r.quality for r in found])
    rows = [(np.frombuffer(r.at, "<u4").astype(np.int32), np.frombuffer(r.value, "<f4")) for r in found]
    del found
    model = fit(rows, labels_of) if rows else None
    del rows
    release()
    return model


def score_batch(rows: list[str], model: Model | None) -> dict[str, list]:
    raws = [t.encode() for t in rows]
    words = [r.split() for r in raws]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
    get = vocabulary.__getitem__
    ids = [np.fromiter(map(get, x), np.int64, len(x)) for x in words]
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for text, raw, own in zip(rows, raws, ids, strict=True):
        out["n_words"].append(len(own))
        for k, x in zip(list(out)[1:], base_counts(raw, len(text), own), strict=True):
            out[k].append(x)
    out["base_failed"] = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, r in zip(out["n_words"], out["n_repeat_words"], strict=True)]
    if model is None:
        out["probability"] = [1.0] * len(rows)
    else:
        weights = model.weights.reshape(FAMILIES, BUCKETS)
        own = np.fromiter(map(word_bucket, vocabulary), np.int64, len(vocabulary))
        logits = []
        for text, raw, x in zip(rows, raws, ids, strict=True):
            three, four = gram_buckets(code_points(text, raw))
            z = model.bias
            for k, g in enumerate((own[x], three, four)):
                if len(g):
                    z += SCALE * float(weights[k][g].mean(dtype=np.float64))
            logits.append(z)
        out["probability"] = model.probability(np.array(logits)).tolist()
    out["kept"] = [not f and p >= KEEP_AT for f, p in zip(out["base_failed"], out["probability"], strict=True)]
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, the base counts, base_failed, probability and kept; with `keep`, also `document`, a struct of docs' columns."""
    model = train(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES x BUCKETS weights
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[F.struct(*(docs[c] for c in docs.columns)).alias("document")] * keep)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, probability double, kept boolean"
    schema += f", document {dict(chosen.dtypes)['document']}" if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_TEXT):
            got = score_batch(texts(batch), shared.value)
            columns = [batch.column(0), *(pa.array(got[c], pa.int64()) for c in counts), pa.array(got["base_failed"], pa.bool_()), pa.array(got["probability"], pa.float64()), pa.array(got["kept"], pa.bool_())]
            if keep:
                columns.append(batch.column(2))
            yield pa.RecordBatch.from_arrays(columns, [id_col, *counts, "base_failed", "probability", "kept", *["document"] * keep])

    return chosen.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their columns."""
    return quality(docs, labels, id_col, text_col, keep=True).where("kept").select("document.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
