"""Op 7: language-model scoring by a subword lattice.

Units are the pieces of an existing vocabulary (sentencepiece, byte fallback), each weighted by its score there. A word's
marginal is the sum over all its segmentations into pieces of the product of their weights, by a forward recursion in log
space, once for each distinct word of the corpus. No piece spans two words, so a text's sum over all segmentations is the
product of its words' marginals and the end's weight: `lattice_score`.

The vocabulary's scores are ranks, so how much a score weighs is learned: pieces fall into classes by score (four to a
doubling of the rank), start of a word or not, and bytes; a class has the share of all pieces that spell the training text,
smoothed by a Zipf law over the ranks, and deals it to its pieces by that law. Pieces of one score class weigh alike, whatever
the corpus says of each: the vocabulary itself is not trained. Weights of all pieces and the end sum to 1.

`score` is the model's: what the lattice knows of spelling joined with what the training documents tell of words. A token is a
known one with probability (1 - u) c / N, or spelt by the lattice with u, the share of training tokens that occur once; both
add up, and the probabilities of all texts sum to 1 at most.

Counting is exact and runs over all training documents. A batch of documents sends its distinct words, packed by bucket; a
bucket adds up their counts, and in a second round returns counts and marginals, a row a batch, to the batches that asked,
where bags of words wait. All of this is in bounded blobs; a frequent word is one entry a batch.

Null text: empty, its one token is the end. Null doc_id: crc32 of the empty text decides on the hold-out. Repeated rows and
ids keep their rows, and count each. Very long texts are scored whole. No training documents: scores weigh by the Zipf law.
An empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, slices, table, texts

SPACE = "▁"
#: Observations that the Zipf law counts as, and what its ranks begin at.
PRIOR, OFFSET = 1000.0, 10
#: Score classes for each doubling of the rank, and of one kind of piece at most.
FINE, CLASSES = 4, 64
NOTHING = -700.0
BATCH_TEXT = 16 << 20
LN10 = math.log(10)


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes(), 1)


def unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, ASCII white space only


# --- the model --------------------------------------------------------------------------------------------------------


class Pieces:
    """The vocabulary: pieces and, for characters without one, bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                self.id_of[piece] = i
        self.size = n
        self.longest = max(map(len, self.id_of))
        rank = np.array([max(0.0, -self.library.get_score(i)) for i in range(n)])
        usable = np.zeros(n, bool)
        usable[list(self.id_of.values())] = usable[self.byte_id] = True
        rank[self.byte_id] = n
        self.prior = np.where(usable, 1 / (rank + OFFSET), 0)
        self.prior /= self.prior.sum()
        self.starting = np.array([i for p, i in self.id_of.items() if p.startswith(SPACE)])
        kind = np.zeros(n, np.int64)
        kind[self.starting] = 1
        kind[self.byte_id] = 2
        self.score_class = kind * CLASSES + np.minimum(CLASSES - 1, FINE * np.log2(rank + 1)).astype(np.int64)

    def weights(self, uses: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
        """Natural logs of the weights of pieces and of the end, from how often each piece spells the training text."""
        uses = np.where(self.prior > 0, uses, 0)
        mass = np.bincount(self.score_class, uses + PRIOR * self.prior, 3 * CLASSES)[self.score_class]
        share = self.prior / np.maximum(np.bincount(self.score_class, self.prior, 3 * CLASSES)[self.score_class], 1e-300)
        total = uses.sum() + PRIOR + ends + 1
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(mass * share / total), NOTHING), math.log((ends + 1) / total)

    def spell(self, words: list[str]) -> list[list[int]]:
        """One segmentation of each word: the library's."""
        return self.library.encode(words, num_threads=1)


_pieces: dict[str, Pieces] = {}


def vocabulary(path: str | None = None) -> Pieces:
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def forward(word: str, log_p: dict[str, float], log_byte: list[float], longest: int) -> float:
    """Natural log of the sum over all spellings of a word (with the mark of its start) by pieces."""
    s = SPACE + word
    alpha = [0.0]
    get, exp = log_p.get, math.exp
    for i in range(1, len(s) + 1):
        c = s[i - 1]
        p = get(c)
        if p is None:
            p = sum([log_byte[b] for b in c.encode()])
        terms = [alpha[i - 1] + p]
        for j in range(max(0, i - longest), i - 1):
            p = get(s[j:i])
            if p is not None:
                terms.append(alpha[j] + p)
        if len(terms) == 1:
            alpha.append(terms[0])
        else:
            top = max(terms)
            alpha.append(top + math.log(sum([exp(t - top) for t in terms])))
    return alpha[-1]


# --- gathering --------------------------------------------------------------------------------------------------------


def gather(docs: DataFrame, buckets: int, id_col: str) -> DataFrame:
    """Rows of a batch: per bucket its distinct words (sorted) with their training counts, and one (bucket -1) with the
    bags of words of its documents. Words are numbered by bucket, then as sorted."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BATCH_TEXT):
            number: dict[bytes, int] = {}
            held = batch.column(2).to_pylist()
            bags, train = [], []
            for text, out in zip(texts(batch), held, strict=True):
                ids = [number.setdefault(w, len(number)) for w in words_of(text)]
                at, n = np.unique(np.array(ids, np.int64), return_counts=True)
                bags.append((at, n))
                if not out:
                    train.append(len(bags) - 1)
            split: list[list[bytes]] = [[] for _ in range(buckets)]
            for w in number:
                split[zlib.crc32(w) % buckets].append(w)
            counts = np.zeros(len(number), np.int64)
            for i in train:
                counts[bags[i][0]] += bags[i][1]
            place = np.zeros(len(number), np.int64)
            rows, at = [], 0
            for bucket, own in enumerate(split):
                if own:
                    own.sort()
                    ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                    place[ids] = np.arange(at, at + len(own))
                    at += len(own)
                    rows.append((bucket, pack(b"\n".join(own)), pack(counts[ids].astype("<u4"))))
            ids, tfs, sizes = [], [], []
            for own, n in bags:
                p = place[own]
                order = np.argsort(p)
                ids.append(np.diff(p[order], prepend=0).astype("<u4"))
                tfs.append(n[order].astype("<u4"))
                sizes.append(len(own))
            none = np.zeros(0, "<u4")
            rows.append((-1, pack(np.array(sizes, "<u4")), pack(np.concatenate([none, *ids])) ))
            m = len(rows)
            lists = lambda x, t: pa.array([None] * (m - 1) + [x], pa.list_(t))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch_id] * m, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
                    lists(batch.column(0).to_pylist(), batch.column(0).type), lists(held, pa.bool_()), pa.array([None] * (m - 1) + [pack(np.concatenate([none, *tfs]))], pa.binary()),
                ],
                ["batch", "bucket", "a", "b", "ids", "held", "tfs"],
            )
            batch_id += 1

    return docs.mapInArrow(run, f"batch bigint, bucket int, a binary, b binary, ids array<{kind}>, held array<boolean>, tfs binary")


def add_up(rows: pa.Table) -> pa.Table:
    """A bucket's words with their counts over all batches."""
    lists = [zstandard.decompress(x).split(b"\n") for x in rows["a"].to_pylist()]
    number = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
    total = np.zeros(len(number), np.int64)
    for own, counts in zip(lists, rows["b"].to_pylist(), strict=True):
        total[np.fromiter(map(number.__getitem__, own), np.int64, len(own))] += unpack(counts, "<u4")
    return pa.table({"bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()), "words": pa.array([pack(b"\n".join(number))], pa.binary()), "counts": pa.array([pack(total)], pa.binary())})


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): pieces that spell the training words, -1 tokens, -2 distinct words, -3 words that occur once."""
    vocab, found = vocabulary(), Counter()
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, counts = zstandard.decompress(words).split(b"\n"), unpack(counts, "<i8").tolist()
            seen = [(w.decode(), c) for w, c in zip(words, counts, strict=True) if c]
            for k in range(0, len(seen), 4096):
                part = seen[k : k + 4096]
                spelt = vocab.spell([w for w, _ in part])
                at = np.fromiter((i for ids in spelt for i in ids), np.int64)
                uses = np.bincount(at, np.repeat([c for _, c in part], [len(ids) for ids in spelt]), vocab.size)
                found.update({i: int(uses[i]) for i in np.flatnonzero(uses).tolist()})
            found[-1] += sum(counts)
            found[-2] += len(seen)
            found[-3] += sum(c == 1 for _, c in seen)
    yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int32()), pa.array(list(found.values()), pa.int64())], ["key", "n"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score. held_out: a Column; None: crc32(id as text) % 10 = 0."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.crc32(id_text(id_col).cast("binary")) % 10 == 0 if held_out is None else held_out
    chosen = docs.select(docs[id_col], docs[text_col].alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    made = materialise(gather(chosen, buckets, id_col), "bags")
    sent = made.where("bucket >= 0").select("bucket", "batch", "a", "b")
    added = materialise(sent.groupBy("bucket").applyInArrow(add_up, "bucket int, words binary, counts binary"), "words")

    stats = {r.key: r.n for r in added.select("words", "counts").mapInArrow(statistics, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # as many rows as pieces, and three
    ends = chosen.where("not held").count()
    n_train, distinct = stats.get(-1, 0) + ends, stats.get(-2, 0) + (ends > 0)
    vocab = vocabulary()
    uses = np.zeros(vocab.size)
    for k, n in stats.items():
        if k >= 0:
            uses[k] = n
    log_weight, log_end = vocab.weights(uses, ends)
    new = min(0.5, (stats.get(-3, 0) + 1) / (n_train + 2)) if n_train else 0.9
    starts = np.exp(log_weight[vocab.starting]).sum()
    stop = (starts + math.exp(log_end)) / starts  # a spelt word: a piece that starts one, others, and no further one
    log_spelt = (math.log(new) + math.log(stop)) / LN10
    known_end = math.log10((1 - new) * ends / n_train if ends else (1 - new) / 2)
    model = spark.sparkContext.broadcast(log_weight)  # one number a piece

    def marginals(asked: pa.Table, known: pa.Table) -> pa.Table:
        """For each batch the counts and marginals of its words in a bucket."""
        pieces, log_w = vocabulary(), model.value
        log_p = {p: float(log_w[i]) for p, i in pieces.id_of.items()}
        log_byte = [float(log_w[i]) for i in pieces.byte_id]
        words = zstandard.decompress(known["words"][0].as_py()).split(b"\n")
        counts = unpack(known["counts"][0].as_py(), "<i8")
        total = np.fromiter((forward(w.decode(), log_p, log_byte, pieces.longest) for w in words), float, len(words)) / LN10
        number = {w: i for i, w in enumerate(words)}
        at = [np.fromiter(map(number.__getitem__, zstandard.decompress(x).split(b"\n")), np.int64) for x in asked["a"].to_pylist()]
        return pa.table({
            "batch": asked["batch"], "bucket": asked["bucket"], "counts": pa.array([pack(counts[x]) for x in at], pa.binary()), "logs": pa.array([total[x].tobytes() for x in at], pa.binary()),
        })

    base_all, base_end = math.log10(n_train + 0.1 * (distinct + 1)), math.log10(ends + 0.1)

    def finish(asked: pa.Table, bag: pa.Table) -> pa.Table:
        asked = asked.sort_by("bucket")
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(x, "<i8") for x in asked["counts"].to_pylist())])
        logs = np.concatenate([np.zeros(0), *(np.frombuffer(x, float) for x in asked["logs"].to_pylist())])
        base = np.log10(counts + 0.1)
        with np.errstate(divide="ignore"):
            mixed = np.logaddexp(np.log((1 - new) * counts / max(1, n_train)), (logs + log_spelt) * LN10) / LN10
        out: list[list] = [[] for _ in range(5)]
        ids, held = bag["ids"][0].as_py(), bag["held"][0].as_py()
        sizes, steps, tfs = unpack(bag["a"][0].as_py(), "<u4"), unpack(bag["b"][0].as_py(), "<u4").astype(np.int64), unpack(bag["tfs"][0].as_py(), "<u4").astype(np.int64)
        at = 0
        for n in sizes.tolist():
            own, tf = np.cumsum(steps[at : at + n]), tfs[at : at + n]
            at += n
            tokens = int(tf.sum()) + 1
            for c, x in zip(out, (tokens, int(tf[counts[own] > 0].sum()) + (ends > 0), float(tf @ base[own]) + base_end - tokens * base_all, float(tf @ mixed[own]) + known_end, float(tf @ logs[own]) + log_end / LN10), strict=True):
                c.append(x)
        return pa.table({
            id_col: pa.array(ids, bag["ids"].type.value_type), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()),
            "train_tokens": pa.array([n_train] * len(ids), pa.int64()), "base_score": pa.array(out[2], pa.float64()), "score": pa.array(out[3], pa.float64()),
            "lattice_score": pa.array(out[4], pa.float64()),
        })

    returned = sent.groupBy("bucket").cogroup(added.groupBy("bucket")).applyInArrow(marginals, "batch bigint, bucket int, counts binary, logs binary")
    bags = made.where("bucket = -1").select("batch", "a", "b", "ids", "held", "tfs")
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double"
    return returned.groupBy("batch").cogroup(bags.groupBy("batch")).applyInArrow(finish, schema)


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
