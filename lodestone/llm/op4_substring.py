"""Op 4: fuzzy repeated passages by collinear chaining.

Words are runs without ASCII white space, A-Z lower-cased. Documents are put in order of their ids and cut into batches; a
document is a distinct pair of id and text, so rows equal in both are one, and unlike texts under one id are several.

Seeds are of two kinds. Minimizers: of each four consecutive five-word shingles the one that hashes lowest, so any run of
eight equal words shares one. Pairs: every second minimizer with another one 11 to 32 words on, chosen by both hashes; only
a stretch of 16 words or more can share one, so short fragments that stand in many documents can't come between two copies
of a passage. Each occurrence of a seed is joined to the one before it in the order of documents and to the first of all,
which are defined by the data alone: results don't depend on partitions. A seed that stands at m places makes 2 m matches,
never m squared. A batch sends a seed once, with its first and last place, and is told what stands before its own.

The matches of a document with another become exact segments, and segments are chained: in order on both sides, a gap costs
its words on either side, best predecessors come from a Fenwick tree over places in the other document. Chains are aligned
(edit distance on the words between segments) and extended to both sides as long as the score doesn't drop; a chain below a
similarity of 0.8 is split at its worst gap and its parts are tried. What a document's chains of 16 words or more cover,
whatever their sources, is merged; a merged stretch of MIN_WORDS or more is a repeated passage. So a document's passage is reported against earlier
documents, or against an earlier place of its own, and the first place that has it stays.

Positions count words, ends are exclusive. Null and empty texts have no words. Rows with a null id are left alone. Ids may
be of any type that sorts. Very long texts make a batch of their own. An empty table gives an empty table. Other columns may
have any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, release, slices, table, texts

WORDS, WINDOW = 5, 4
#: Words between the two shingles of a pair.
NEAREST, FURTHEST = 11, 32
#: Fewest words of a passage: those of 50 words whose edits near their ends go unmatched still count.
MIN_WORDS, SIMILARITY = 40, 0.8
#: A chain breaks at a longer gap between segments; words that a chain can be extended by on each side.
MAX_GAP, MARGIN = 30, 32
#: Fewest words that a chain's segments have, and that it has when aligned: what a pair of seeds spans at least.
MIN_MATCHED, MIN_ALIGNED = 8, WORDS + 11
#: Words between a document's segments (of all its others) that stand near each other, and the fewest words that these cover.
NEARBY, MIN_NEAR = 30, 12
#: A chain's cost for a word of a gap (mean of both sides); words by which its segments may overlap.
GAP_COST, OVERLAP = 0.25, 4
#: An extension's cost for an edit, and the drop below its best score that ends it.
EDIT_COST, DROP = 4.0, 10.0
#: Words between two chains of a document that a merged stretch may hold.
BRIDGE = 8
BATCH_TEXT, BATCH_WORDS = 4 << 20, 1 << 18
#: Parts that the requests for one document's words are dealt to.
SALTS = 64
#: Bits of a document's number that count it in its batch, and of a batch's number that count it in its partition.
INDEX_BITS, SERIAL_BITS = 22, 18
WORD = re.compile("[^\x20\x09-\x0d]+")
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
HASH_MASK = np.uint64(0xFFFFFFFFFFFF0000)  # six bytes: a chance match alone makes no chain


def word_hashes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, end to end, and the number of words of each text."""
    known: dict[bytes, int] = {}
    get, digest = known.get, xxhash.xxh64_intdigest
    out, sizes = [], []
    for text in rows:
        words = text.encode().lower().split()
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = digest(w, 1)
            out.append(h)
        sizes.append(len(words))
    return np.array(out, np.uint64), np.array(sizes, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word position of all runs of five words of each text."""
    n = np.maximum(sizes - WORDS + 1, 0)
    which = np.repeat(np.arange(len(sizes)), n)
    position = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + position
    h = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    return np.minimum(mix(h), NONE - np.uint64(1)), which, position


def minimizers(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and word position of each text's minimizers, by text and position."""
    h, which, position = shingles(hashes, sizes)
    slot = np.arange(len(h)) + (which + 1) * (WINDOW - 1)  # before, between and after texts stand places that no window picks
    wide = np.full(len(h) + (len(sizes) + 2) * (WINDOW - 1) + 1, NONE)
    wide[slot] = h
    least = wide.copy()
    for k in (1, 2):
        least[:-k] = np.minimum(least[:-k], least[k:])
    picked = np.zeros(len(wide), bool)
    for k in range(WINDOW):
        picked[k:] |= wide[k:] == least[: len(wide) - k]
    keep = picked[slot]
    return h[keep], which[keep], position[keep]


def seeds(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, word position and offset of the second shingle (0: none) of all seeds, by hash, text and position."""
    h, which, position = minimizers(hashes, sizes)
    at = np.flatnonzero(h >> np.uint64(20) & np.uint64(1))
    best, mate = np.full(len(at), NONE), np.zeros(len(at), np.int64)
    for k in range(1, FURTHEST + 1):
        other = at + k
        inside = other < len(h)
        other = np.where(inside, other, 0)
        step = position[other] - position[at]
        inside &= (which[other] == which[at]) & (step <= FURTHEST)
        if not inside.any():
            break
        value = (h[at] ^ h[other]) * np.uint64(0x9E3779B97F4A7C15)
        better = inside & (step >= NEAREST) & (value < best)
        best[better], mate[better] = value[better], step[better]
    paired = mate > 0
    pairs, at, mate = mix(best[paired] + np.uint64(0x5851F42D4C957F2D)), at[paired], mate[paired]
    h, which = np.r_[h, pairs] & HASH_MASK, np.r_[which, which[at]]
    position, mate = np.r_[position, position[at]], np.r_[np.zeros(len(position), np.int64), mate]
    order = np.lexsort((mate, position, which, h))
    return h[order], which[order], position[order], mate[order]


# --- packed columns ---------------------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns end to end, each as its first bytes, then its second bytes and so on; the first column, ascending, as steps."""
    head = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    return zstandard.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in (head, *columns[1:])), 1)


def unpack(raw: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(k))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


#: A batch's entry for a seed: hash; index, position and second offset of its first place; the same of its last, as differences.
ENTRY = ("<u8", "<u4", "<u4", "u1", "<u4", "<u4", "u1")
#: What a batch is told of a seed: hash; batch, index, position and second offset of the first place of all, and of the last before.
ANSWER = ("<u8", "<i8", "<u4", "<u4", "u1", "<i8", "<u4", "<u4", "u1")


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def narrow(hashes: np.ndarray) -> np.ndarray:
    """Three bytes of each word's hash: enough to tell words at one place apart, and five in a row anywhere."""
    return np.ascontiguousarray(hashes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def binaries(words: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow binary column of consecutive stretches of narrow words."""
    offsets = np.r_[0, np.cumsum(sizes)] * 3
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words)]).cast(pa.binary())


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash of the text), words (three bytes each): one row per document, or more where copies are far apart."""
    chosen = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text")).where("id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_TEXT):
            seen = dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if len(seen) < batch.num_rows:
                first: dict = {}
                for i, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    first.setdefault(pair, i)
                batch = pa.Table.from_batches([batch]).take(pa.array(sorted(first.values()))).combine_chunks().to_batches()[0]
            hashes, sizes = word_hashes(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binaries(narrow(hashes), sizes)], ["id", "key", "words"])

    return chosen.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, key bigint, words binary")


def numbered(rows: DataFrame, id_type: str) -> DataFrame:
    """batch, ord, id, key, words: documents in order of id and key, numbered so that `ord` ascends, in batches of bounded size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, "id", "key").sortWithinPartitions("id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, index, held, last = TaskContext.get().partitionId() << SERIAL_BITS, -1, 0, None
        for rows in batches:
            kept, of, number = [], [], []
            sizes = [len(x.as_buffer()) // 3 for x in rows.column(2)]
            for i, pair in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                if pair == last:  # the same id and text: the same document
                    continue
                last = pair
                if index >= 0 and held + sizes[i] > BATCH_WORDS:
                    batch, index, held = batch + 1, -1, 0
                index, held = index + 1, held + sizes[i]
                kept.append(i)
                of.append(batch)
                number.append(batch << INDEX_BITS | index)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(number, pa.int64()), *(rows.column(i).take(at) for i in range(3))], ["batch", "ord", "id", "key", "words"])

    return sorted_rows.mapInArrow(run, f"batch bigint, ord bigint, id {id_type}, key bigint, words binary")


def joined_words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of documents, end to end, and their numbers."""
    raw = [x.as_buffer() for x in column]
    return wide(b"".join(raw)), np.array([len(x) // 3 for x in raw], np.int64)


def entries(documents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, data): a batch's seeds by hash, each with its first and last place in the batch."""

    def made(batch: int, index: list[int], raw: list) -> pa.RecordBatch:
        words, sizes = wide(b"".join(raw)), np.array([len(x) // 3 for x in raw], np.int64)
        h, which, pos, mate = seeds(words.astype(np.uint64), sizes)
        which = np.array(index, np.int64)[which] if len(h) else which
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        last = np.r_[first[1:], len(h)] - 1 if len(h) else first
        bucket = bucket_of(h[first], buckets)
        order = np.argsort(bucket, kind="stable")  # within a bucket still by hash
        a, b = first[order], last[order]
        columns = [h[a], which[a].astype("<u4"), pos[a].astype("<u4"), mate[a].astype("u1"), (which[b] - which[a]).astype("<u4"), (pos[b].astype("<u4") - pos[a].astype("<u4")), mate[b].astype("u1") - mate[a].astype("u1")]
        own, starts = np.unique(bucket[order], return_index=True)
        edges = [*starts.tolist(), len(order)]
        data = [pack(*(c[i:j] for c in columns)) for i, j in pairwise(edges)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([batch] * len(own), pa.int64()), pa.array(data, pa.binary())], ["bucket", "batch", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, raw = -1, [], []
        for rows in batches:
            for batch, number, words in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if batch != now:
                    if raw:
                        yield made(now, index, raw)
                    now, index, raw = batch, [], []
                index.append(number & ((1 << INDEX_BITS) - 1))
                raw.append(words)
        if raw:  # a batch that two tasks share is sent in two parts
            yield made(now, index, raw)
        release()

    return documents.select("batch", "ord", "words").mapInArrow(run, "bucket int, batch bigint, data binary")


def answers(rows: pa.Table) -> pa.Table:
    """(batch, data): for the seeds of a bucket that stand in several batches, what comes before each batch's own."""
    ids = rows["batch"].to_numpy()
    parts = [unpack(x, ENTRY) for x in rows["data"].to_pylist()]
    h, index, pos, mate, index2, pos2, mate2 = (np.concatenate(c) for c in zip(*parts, strict=True))
    batch = np.repeat(ids, [len(p[0]) for p in parts])
    order = np.lexsort((index, batch, h))
    h, batch, index, pos, mate, index2, pos2, mate2 = (c[order] for c in (h, batch, index, pos, mate, index2, pos2, mate2))
    index2, pos2, mate2 = index + index2, pos + pos2, mate + mate2
    first = np.r_[True, h[1:] != h[:-1]][: len(h)]
    of = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.flatnonzero(~first)
    later = later[(batch[later] != batch[of[later]]) & (batch[later] != batch[later - 1])]
    later = later[np.argsort(batch[later], kind="stable")]  # within a batch still by hash
    src, prev = of[later], later - 1
    columns = [h[later], batch[src].astype("<i8"), index[src], pos[src], mate[src], batch[prev].astype("<i8"), index2[prev], pos2[prev], mate2[prev]]
    own, starts = np.unique(batch[later], return_index=True)
    edges = [*starts.tolist(), len(later)]
    out = pa.table({"batch": pa.array(own, pa.int64()), "data": pa.array([pack(*(c[i:j] for c in columns)) for i, j in pairwise(edges)], pa.binary())})
    del parts, h, index, pos, mate, index2, pos2, mate2, batch, order, columns
    release()
    return out


# --- chains -----------------------------------------------------------------------------------------------------------

Segment = tuple[int, int, int, int]  # start, end, start there, end there


def segments(doc: np.ndarray, ref: np.ndarray, pos: np.ndarray, ref_pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, ref, start, end, ref_start, ref_end of the exact segments that matched shingles make up, by doc, ref and start."""
    order = np.lexsort((pos, ref_pos - pos, ref, doc))
    doc, ref, pos, ref_pos = doc[order], ref[order], pos[order], ref_pos[order]
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (ref_pos[1:] - pos[1:] != ref_pos[:-1] - pos[:-1]) | (pos[1:] - pos[:-1] > WORDS)][: len(doc)]
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(doc)] - 1 if len(a) else a
    found = doc[a], ref[a], pos[a], pos[b] + WORDS, ref_pos[a], ref_pos[b] + WORDS
    order = np.lexsort((found[4], found[2], found[1], found[0]))
    return tuple(c[order] for c in found)


def telling(doc: np.ndarray, ref: np.ndarray, start: np.ndarray, end: np.ndarray, ref_start: np.ndarray, ref_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments (by doc and ref) that can add to what is covered: of those that lie within an exact segment of MIN_ALIGNED
    words or more of the same document only that one is needed, and what stands alone, with too few words near it, can't
    become a passage."""
    if not len(doc):
        return doc, ref, start, end, ref_start, ref_end
    columns = doc, ref, start, end, ref_start, ref_end
    pair = np.r_[True, (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1])]
    total = np.add.reduceat(end - start, np.flatnonzero(pair))[np.cumsum(pair) - 1]
    columns = tuple(c[total >= MIN_MATCHED] for c in columns)
    doc, ref, start, end = columns[:4]
    order = np.lexsort((ref, -end, start, doc))
    base = doc[order].astype(np.int64) << np.int64(32)
    reach = np.where(end[order] - start[order] >= MIN_ALIGNED, base + end[order], base)
    reach = np.maximum.accumulate(np.r_[np.int64(-1), reach])[:-1] if len(order) else reach  # of what begins before or at the same place
    order = np.sort(order[reach < base + end[order]])
    columns = tuple(c[order] for c in columns)
    doc, ref, start, end = columns[:4]
    order = np.lexsort((end, start, doc))
    base = doc[order].astype(np.int64) << np.int64(32)
    first, last = base + start[order], base + end[order]
    reach = np.maximum.accumulate(np.r_[np.int64(-1 << 40), last])[:-1]
    island = np.cumsum(first - reach > NEARBY) if len(order) else first
    added = np.maximum(last - np.maximum(first, reach), 0)
    near = np.bincount(island, added, island[-1] + 1)[island] if len(order) else added
    order = np.sort(order[near >= MIN_NEAR])
    return tuple(c[order] for c in columns)


def best_chains(found: list[Segment]) -> tuple[list[float], list[int]]:
    """For the segments of two documents (by start) the score of the best chain that each ends, and its segment before (-1: none)."""
    n = len(found)
    cost = GAP_COST / 2
    ranks = sorted({s[3] - OVERLAP for s in found})
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)  # Fenwick: the best of score + cost * place, by prefix of the end there
    score, before = [0.0] * n, [-1] * n
    ends, e = sorted(range(n), key=lambda m: found[m][1]), 0
    for j, (start, end, ref_start, _) in enumerate(found):
        while found[ends[e]][1] - OVERLAP <= start:  # what ends before this segment starts
            m = ends[e]
            value, k = (score[m] + cost * (found[m][1] + found[m][3]), m), bisect_left(ranks, found[m][3] - OVERLAP) + 1
            while k < len(tree):
                if tree[k][0] < value[0]:
                    tree[k] = value
                k += k & -k
            e += 1
        best, at, k = 0.0, -1, bisect_right(ranks, ref_start)
        while k > 0:
            if tree[k][0] > best:
                best, at = tree[k]
            k &= k - 1
        gain = best - cost * (start + ref_start)
        score[j] = end - start
        if at >= 0 and gain > 0:
            score[j], before[j] = score[j] + gain, at
    return score, before


def chain(found: list[Segment]) -> list[list[Segment]]:
    """Chains of the segments of two documents (by start); each segment is in one."""
    n = len(found)
    if n == 1:
        return [found]
    score, before = best_chains(found)
    chains, used = [], [False] * n
    for end in sorted(range(n), key=lambda m: (-score[m], m)):
        if used[end]:
            continue
        path, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(found[m])
            m = before[m]
        path.reverse()
        start = 0
        for k in range(1, len(path) + 1):
            if k == len(path) or path[k][0] - path[k - 1][1] > MAX_GAP or path[k][2] - path[k - 1][3] > MAX_GAP:
                chains.append(path[start:k])
                start = k
    return chains


def matched(path: list[Segment]) -> int:
    return sum(s[1] - s[0] for s in path)


# --- alignment --------------------------------------------------------------------------------------------------------


def edits(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is `most` at most, else most + 1; the furthest rows of each diagonal, by cost."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far: dict[int, int] = {}
    for d in range(most + 1):
        now: dict[int, int] = {}
        for k in range(-min(d, most), min(d, most) + 1):
            i = 0 if d == 0 else max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)  # diagonal k: j = i + k
            if i < 0:
                continue
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            now[k] = i
            if i == n and i + k == m:
                return d
        far = now
    return most + 1


def extend(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Words of a, words of b and edits of the best common start of two sequences: a word on both sides scores 1, an edit
    costs EDIT_COST; ends where no diagonal is within DROP of the best."""
    n, m = len(a), len(b)
    far: dict[int, int] = {}
    best, found, d = 0.0, (0, 0, 0), 0
    while d <= n + m:
        now: dict[int, int] = {}
        top = -1e9
        for k in range(-d, d + 1):
            i = 0 if d == 0 else max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            value = (2 * i + k) / 2 - EDIT_COST * d
            if value >= best - DROP:
                now[k] = i
                top = max(top, value)
            if value > best:
                best, found = value, (i, i + k, d)
        if top < best - DROP or not now:
            break
        far, d = now, d + 1
    return found


def same_start(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """The equal start of two sequences, as extend gives it."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return n, n, 0


def align(path: list[Segment], own: list[int], ref: list[int], same: bool) -> list[tuple[int, int, int, int, float]]:
    """Start, end, start there, end there and similarity of the alignments that a chain gives; places as in the chain, which
    `own` and `ref` begin at 0 for. In the same document only equal words extend it, or it would meet itself."""
    clean = [path[0]]
    for start, end, ref_start, ref_end in path[1:]:
        over = max(0, clean[-1][1] - start, clean[-1][3] - ref_start)
        if over < end - start:
            clean.append((start + over, end, ref_start + over, ref_end))
    gaps = []
    for (_, a, _, b), (c, _, d, _) in pairwise(clean):
        gaps.append(edits(own[a:c], ref[b:d], max(c - a, d - b)))
    start, end, ref_start, ref_end = clean[0][0], clean[-1][1], clean[0][2], clean[-1][3]
    size, cost = max(end - start, ref_end - ref_start), sum(gaps)
    if cost > (1 - SIMILARITY) * size + 1e-9:
        worst = max(range(len(gaps)), key=lambda k: gaps[k]) + 1
        return [x for part in (clean[:worst], clean[worst:]) if matched(part) >= MIN_MATCHED for x in align(part, own, ref, same)]
    core = (start, end, ref_start, ref_end, 1 - cost / size)
    on = same_start if same else extend
    left = on(own[max(0, start - MARGIN) : start][::-1], ref[max(0, ref_start - MARGIN) : ref_start][::-1])
    right = on(own[end : end + MARGIN], ref[ref_end : ref_end + MARGIN])
    start, end, ref_start, ref_end = start - left[0], end + right[0], ref_start - left[1], ref_end + right[1]
    size, cost = max(end - start, ref_end - ref_start), cost + left[2] + right[2]
    found = (start, end, ref_start, ref_end, 1 - cost / size) if cost <= (1 - SIMILARITY) * size + 1e-9 else core
    return [found] if found[1] - found[0] >= MIN_ALIGNED else []


def local(own: pa.Table, told: pa.Table) -> pa.Table:
    """Of a batch: aligned chains between its own documents, and chains that need another batch's words (with `span`)."""
    own = own.sort_by("ord")
    number = own["ord"].to_numpy()
    words, sizes = joined_words(own["words"])
    h, which, pos, mate = seeds(words.astype(np.uint64), sizes)
    first = np.r_[True, h[1:] != h[:-1]][: len(h)]
    later = np.flatnonzero(~first)
    of = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else later
    pairs = [(later, number[which[later - 1]], pos[later - 1], mate[later - 1])]
    parts = [unpack(x, ANSWER) for x in told["data"].to_pylist()]
    origin, origin_pos, origin_mate = number[which[of]], pos[of], mate[of]  # the first place of all
    if parts:
        known, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(known, kind="stable")
        known, columns = known[order], [c[order] for c in columns]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        a_batch, a_index, a_pos, a_mate, b_batch, b_index, b_pos, b_mate = (c[at] for c in columns)
        a, b = a_batch << INDEX_BITS | a_index.astype(np.int64), b_batch << INDEX_BITS | b_index.astype(np.int64)
        origin, origin_pos, origin_mate = np.where(hit, a, origin), np.where(hit, a_pos, origin_pos), np.where(hit, a_mate, origin_mate)
        lead = np.flatnonzero(first & hit)
        pairs.append((lead, b[lead], b_pos[lead], b_mate[lead]))
        rest = np.flatnonzero(hit | ~first)
    else:
        rest = later
    pairs.append((rest, origin[rest], origin_pos[rest], origin_mate[rest]))
    at, ref, ref_pos, ref_mate = (np.concatenate(c).astype(np.int64) for c in zip(*pairs, strict=True))
    doc, own_pos, own_mate = which[at], pos[at], mate[at]
    two = own_mate > 0
    doc, ref = np.r_[doc, doc[two]], np.r_[ref, ref[two]]
    own_pos, ref_pos = np.r_[own_pos, own_pos[two] + own_mate[two]], np.r_[ref_pos, ref_pos[two] + ref_mate[two]]
    earlier = (ref != number[doc]) | (ref_pos < own_pos)  # two pairs of a text can share their second shingle
    doc, ref, own_pos, ref_pos = doc[earlier], ref[earlier], own_pos[earlier], ref_pos[earlier]
    doc, ref, start, end, ref_start, ref_end = telling(*segments(doc, ref, own_pos, ref_pos))

    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1])][: len(doc)])
    total = np.add.reduceat(end - start, cut) if len(cut) else cut
    begins = np.cumsum(sizes) - sizes
    place = {int(x): i for i, x in enumerate(number.tolist())}
    held: dict[int, list[int]] = {}

    def words_of(i: int) -> list[int]:
        if i not in held:
            held[i] = words[begins[i] : begins[i] + sizes[i]].tolist()
        return held[i]

    rows: list[tuple] = []
    columns = [c.tolist() for c in (start, end, ref_start, ref_end)]
    before = -1
    for (lo, hi), n in zip(pairwise([*cut.tolist(), len(doc)]), total.tolist(), strict=True):
        if n < MIN_MATCHED:
            continue
        i, r = int(doc[lo]), int(ref[lo])
        if i != before:
            held, before = {}, i
        for path in chain(list(zip(*(c[lo:hi] for c in columns), strict=True))):
            if matched(path) < MIN_MATCHED:
                continue
            if r in place:
                rows += [(number[i], r, *got, None, None, None) for got in align(path, words_of(i), words_of(place[r]), r == number[i])]
            else:
                at = max(0, path[0][0] - MARGIN)
                span = words[begins[i] + at : begins[i] + min(int(sizes[i]), path[-1][1] + MARGIN)]
                rows.append((number[i], r, path[0][0], path[-1][1], path[0][2], path[-1][3], None, at, narrow(span).tobytes(), np.array(path, "<i4").tobytes()))
    made = list(zip(*rows, strict=True)) if rows else [[]] * 10
    del h, which, pos, mate, parts, pairs, at, ref, ref_pos, ref_mate, doc, own_pos, own_mate, rows, columns, words, held
    release()
    return pa.table({k: pa.array(c, t) for k, c, t in zip(LOCAL, made, LOCAL_KINDS, strict=True)})


LOCAL = ("doc", "ref", "start", "end", "ref_start", "ref_end", "similarity", "span_at", "span", "path")
LOCAL_KINDS = (*[pa.int64()] * 6, pa.float64(), pa.int64(), pa.binary(), pa.binary())
ALIGNED = "doc bigint, ref bigint, start bigint, end bigint, ref_start bigint, ref_end bigint, similarity double"


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments of chains whose other document's words have come: doc, ref, span_at, span, path, ref_at, ref_span."""
    for batch in batches:
        rows = []
        for doc, ref, at, span, path, ref_at, ref_span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, other = wide(span).tolist(), wide(ref_span).tolist()
            steps = [(a - at, b - at, c - ref_at, d - ref_at) for a, b, c, d in np.frombuffer(path, "<i4").reshape(-1, 4).tolist()]
            rows += [(doc, ref, a + at, b + at, c + ref_at, d + ref_at, s) for a, b, c, d, s in align(steps, own, other, doc == ref)]
        made = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, LOCAL_KINDS, strict=False)], list(LOCAL[:7]))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, ref_doc_id, start, end, ref_start, ref_end, similarity, passage_start, passage_end: the aligned chains
    that make up each repeated passage; the reference is a document before it in the order of ids, or an earlier place of the
    same. text_key is xxhash64 of the document's text, which tells documents under one id apart."""
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(hashed(docs, id_col, text_col), "words")
    documents = materialise(numbered(rows, dict(docs.dtypes)[id_col]), "documents")
    discard(rows)
    told = entries(documents, buckets).groupBy("bucket").applyInArrow(answers, "batch bigint, data binary")
    told = materialise(told, "answers")
    schema = f"{ALIGNED}, span_at bigint, span binary, path binary"
    found = documents.select("batch", "ord", "words").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(local, schema)
    found = materialise(found, "chains")
    discard(told)

    # a document that many others refer to is copied to SALTS parts of them at most
    asked = found.where("span is not null").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    copies = asked.select("ref", "salt").distinct().join(documents.select(F.col("ord").alias("ref"), "words"), "ref")
    from_word = F.greatest(F.col("ref_start") - MARGIN, F.lit(0))
    ref_span = F.substring(F.col("words"), (from_word * 3 + 1).cast("int"), ((F.col("ref_end") + MARGIN - from_word) * 3).cast("int"))
    met = asked.join(copies, ["ref", "salt"]).select("doc", "ref", "span_at", "span", "path", from_word.alias("ref_at"), ref_span.alias("ref_span"))
    aligned = found.where("span is null").select(*LOCAL[:7]).unionByName(met.mapInArrow(across, ALIGNED))
    aligned = materialise(aligned, "aligned")
    discard(found)

    # a document has six matches a seed's place at most, so its chains are bounded by its own length
    by_start = Window.partitionBy("doc").orderBy("start", "end", "ref", "ref_start")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = aligned.withColumn("new", (reach.isNull() | (F.col("start") > reach + BRIDGE)).cast("int")).withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("doc", "island")
    out = marked.withColumn("passage_start", F.min("start").over(island)).withColumn("passage_end", F.max("end").over(island)).where(F.col("passage_end") - F.col("passage_start") >= min_words)
    names = documents.select(F.col("ord").alias("doc"), F.col("id").alias("doc_id"), F.col("key").alias("text_key"))
    refs = documents.select(F.col("ord").alias("ref"), F.col("id").alias("ref_doc_id"))
    return out.join(names, "doc").join(refs, "ref").select("doc_id", "text_key", "ref_doc_id", "start", "end", "ref_start", "ref_end", "similarity", "passage_start", "passage_end")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans (ascending, apart) and the white space after each span."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end][0] if end < len(places) else len(text)
    out.append(text[at:])
    return "".join(out)


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of all but the first place that has them. Documents that nothing is left of go."""
    spans = found.select("doc_id", "text_key", "passage_start", "passage_end").distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("passage_start", "passage_end"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), "spans")  # bounded by the document's length
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("document"))
    joined = rows.join(spans, (rows["id"] == spans["cut_id"]) & (rows["key"] == spans["cut_key"]), "left").select("text", "spans", "document")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, left = [], []
            for k, (text, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own and text is not None:
                    text = cut(text, [(s["passage_start"], s["passage_end"]) for s in own])
                    if not text.strip():
                        continue
                kept.append(k)
                left.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), batch.column(2).take(pa.array(kept, pa.int64()))], ["text", "document"])

    done = joined.mapInArrow(run, f"text string, document {dict(joined.dtypes)['document']}")
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("document").getField(c).alias(c) for c in docs.columns))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
