"""Op 1: best-fit packing of token sequences.

Only counts of pieces by length decide a packing, so it is planned on that table: `capacity` rows at most, whatever the
corpus holds. Pieces above a third of the capacity go in at most twice per bin: from the longest down, each is matched with
the longest such piece that fits beside it, which is the greedy matching. Shorter pieces, longest first, go to the smallest
gap that holds them, else to a new bin. The plan is a list of runs: pieces of one length, by rank, into a range of equal
bins. Each piece has a rank in its length from its place in the task that made it and a running sum over tasks, and finds
its run by binary search.

A longer document is cut: its first piece is the remainder, all others are full. A null text is empty: the end id alone.

Ids are those of the tokenizers library. They come from the library that is fastest for whole texts; on texts with code points
for which the two differ (found by asking both about each once), with any above U+FFFF, or with very long white space, which
overflows its stack, from op 9's coder, which is exact for all.

Null ids, repeated rows and ids keep their rows, each its own pieces; ties of length go by place. Very long texts are encoded
whole. An empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import op9_bpe
from .common import materialise, slices, table, texts

CAPACITY = 2048
END_ID = 0
#: A run of so many white space characters goes another way.
LONG_SPACE = 4000

_encoders: dict[str, object] = {}


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder():
    """The vocabulary of byte_bpe_50k.json in the library that is fastest for whole texts; ids are the same."""
    if "byte_bpe_50k" not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders["byte_bpe_50k"] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return _encoders["byte_bpe_50k"]


def unlike(path: str, points: Iterable[int]) -> set[int]:
    """Code points on which the two libraries differ."""
    from tokenizers import Tokenizer

    library, quick, found = Tokenizer.from_file(path), encoder(), set()
    for c in points:
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}{chr(c)}a {chr(c)}1"
            if quick.encode_ordinary(s) != library.encode(s, add_special_tokens=False).ids:
                found.add(c)
    return found


def other_way(spark: SparkSession | None = None) -> str:
    """A pattern of what has to go by op 9's coder: code points on which the two libraries differ, and long white space."""
    return rf"{op9_bpe.probed(unlike, public_path(), spark)}|\s{{{LONG_SPACE}}}"


def token_ids(text: str, exact_only, rare: str | None = None) -> np.ndarray:
    """Ids of a text and the end; `exact_only` searches for what other_way() names, `rare` is for op 9's coder."""
    if exact_only(text):
        return np.r_[np.frombuffer(op9_bpe.coder(rare=rare).encode_batch([text])[0], "<u4"), np.uint32(END_ID)].astype("<u4")
    enc = encoder()
    got = enc.encode(text, allowed_special="all") if "<|endoftext|>" in text else enc.encode_ordinary(text)
    return np.array([*got, END_ID], "<u4")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs as rows (length, first rank, first bin, pieces per bin, offset of the first), by length and rank.

    Rank r of a length stands in the run with the last first rank up to r, in bin `first bin + (r - first rank) // per bin`.
    """
    left = dict(counts)
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges (first bin, bins)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(length: int, first: int, n_bins: int, per_bin: int, offset: int, n: int | None = None) -> None:
        runs.append((length, used[length], first, per_bin, offset))
        used[length] += n_bins * per_bin if n is None else n

    large = sorted((x for x in left if x > capacity // 3 and left[x] > 0), reverse=True)
    for i, a in enumerate(large):
        j = i
        while left[a] > 0:
            while j < len(large) and (large[j] + a > capacity or left[large[j]] < 1 + (large[j] == a)):
                j += 1
            if j == len(large):
                n = left[a]
                put(a, bins, n, 1, 0)
                gaps[capacity - a].append((bins, n))
                left[a] = 0
            else:
                b = large[j]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, bins, n, 1, 0)
                put(b, bins, n, 1, a)
                gaps[capacity - a - b].append((bins, n))
                left[a] -= n
                left[b] -= n
            bins += n
    for a in sorted((x for x in left if x <= capacity // 3 and left[x] > 0), reverse=True):
        n = left[a]
        for gap in sorted(g for g in gaps if g >= a):
            if not n:
                break
            per, ranges = gap // a, gaps.pop(gap)
            for k, (first, m) in enumerate(ranges):
                full = min(m, n // per)
                if full:
                    put(a, first, full, per, capacity - gap)
                    gaps[gap - per * a].append((first, full))
                    n -= full * per
                if full < m:
                    if n:  # the last pieces of this length, fewer than the bin takes
                        put(a, first + full, 1, per, capacity - gap, n)
                        gaps[gap - n * a].append((first + full, 1))
                        full, n = full + 1, 0
                    if full < m:
                        gaps[gap].append((first + full, m - full))
                    gaps[gap] += ranges[k + 1 :]
                    break
        if n:
            per = capacity // a
            full = n // per
            if full:
                put(a, bins, full, per, 0)
                gaps[capacity - per * a].append((bins, full))
                bins, n = bins + full, n - full * per
            if n:
                put(a, bins, 1, per, 0, n)
                gaps[capacity - n * a].append((bins, 1))
                bins += 1
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, ids: bool) -> DataFrame:
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, place bigint" + ", ids array<int>" * ids
    pattern, rare = other_way(docs.sparkSession), op9_bpe.probed(op9_bpe.unlike, public_path(), docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        exact_only = re.compile(pattern).search
        for batch in slices(batches):
            of, columns = [], [[] for _ in range(6 + ids)]
            for i, text in enumerate(texts(batch)):
                got = token_ids(text, exact_only, rare)
                first = len(got) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(got), capacity)]):
                    own = got[start : first if not k else start + capacity]
                    of.append(i)
                    for c, x in zip(columns, (k, start, len(own), zlib.crc32(own.tobytes()), task, seen[len(own)]), strict=False):
                        c.append(x)
                    if ids:
                        columns[6].append(own.astype(np.int32))
                    seen[len(own)] += 1
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *made], [id_col, "piece", "start", "length", "ids_crc32", "task", "place", "ids"][: 7 + ids])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, its ids."""
    made = materialise(pieces(docs, capacity, id_col, text_col, ids), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = per_task.select("task", "length", F.coalesce(earlier, F.lit(0)).cast("bigint").alias("before"))
    totals = made.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row per length, `capacity` at most
    runs = docs.sparkSession.sparkContext.broadcast(plan({r.length: r.n for r in totals}, capacity))
    out = [f"`{id_col}` {dict(docs.dtypes)[id_col]}", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "sequence_id bigint", "offset bigint"] + ["ids array<int>"] * ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, rank_of, first, per, offset = runs.value.T
        starts = length_of << 44 | rank_of
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(starts, length << 44 | rank, "right") - 1
            k = rank - rank_of[at]
            bins, offsets = first[at] + k // per[at], offset[at] + k % per[at] * length
            columns = [*(batch.column(i) for i in range(5)), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64()), *([batch.column(6)] if ids else [])]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: 7 + ids])

    ranked = made.join(before, ["task", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"), *["ids"] * ids)
    return ranked.mapInArrow(place, ", ".join(out))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
