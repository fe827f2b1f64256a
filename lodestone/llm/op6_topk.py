"""Op 6: exact top-k by inner product over a bit-sliced index.

Components become integers floor(1024 x). The index holds blocks of rows; in a block the high bits of each attribute stand
as bit slices, one bitmap per attribute and bit. For a query, slices are added with bitmap arithmetic (carry-save adders,
one weight after the other), which gives the slices of a coarse score. The k-th coarse score is found from the most
significant slice downward. A coarse score is off by less than a known amount, so rows that the amount could lift to the
k-th are selected the same way, and these boundary rows alone get exact scores.

Every index block meets every block of queries once: index blocks have a cell, query blocks are copied to every cell, and
the join is on the cell; there are as many cells as index blocks, up to a few for each shuffle partition. Vectors that are
null, empty or hold null or non-finite components take no part; rows of another dimension than a query's are no candidates of
it. A query with fewer candidates than k returns all. Rows that repeat a query's vec_id are the query's own; of several valid
vectors under one query id the least asks. Ties go to the smaller vec_id. An empty table gives an empty table. Columns other
than vec_id and embedding are ignored, whatever their names.

Integers are exact at any size: rows beyond 31 bits are held in 64, beyond 53 as the doubles they come from, and multiplied as
unbounded integers where 64 bits might not do. A score of a result that does not fit a long is an error, never another number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

K, EVERY, SCALE = 10, 100, 1024
BLOCK, QUERY_BLOCK = 8192, 128
#: Cells for each shuffle partition, at most.
CELLS = 8
#: Low bits that the slices leave out; a block that has to leave out this many more is scored without slices.
DROPPED, TOO_MANY = 4, 30
#: How a block holds its integers: 32 bits, 64 bits, or the doubles that give them; by a row's greatest.
SMALL, LARGE, RAW = 0, 1, 2
LONG = 1 << 63


def whole(x: float) -> int:
    """floor(SCALE * x), also where the product leaves the doubles."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x)


def vectors_of(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and vectors (doubles) of the rows that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[(lengths > 0) & known]).tolist():
        rows = np.flatnonzero((lengths == dim) & known)
        own = vectors.take(pa.array(rows))
        x = own.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null: NaN
        good = np.isfinite(x).all(axis=1)
        if good.any():
            out[dim] = ids.take(pa.array(rows[good])).to_numpy(zero_copy_only=False).astype(np.int64), x[good]
    return out


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64 bits, or unbounded integers where a double no longer counts by ones."""
    if np.abs(x).max(initial=0.0) < 2.0**43:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def by_kind(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1)
    return np.where(top < 2.0**20, SMALL, np.where(top < 2.0**43, LARGE, RAW))


def slices_of(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Bitmaps (attribute, bit, words) of the high bits above their least, that least, and the bits dropped."""
    dropped = DROPPED
    while (int(x.max()) >> dropped) - (int(x.min()) >> dropped) >= 1 << 10:  # ten slices an attribute at most
        dropped += 1
    high = x >> dropped
    least = int(high.min())
    width = max(1, int(high.max() - least).bit_length())
    n = len(x)
    bits = ((high - least).T[:, None, :] >> np.arange(width)[None, :, None] & 1).astype(np.uint8)
    bits = np.concatenate([bits, np.zeros((*bits.shape[:2], -n % 64), np.uint8)], axis=2)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), least, dropped


def add_slices(weighted: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Slices of the sum of all bitmaps, each times two to its weight: three of a weight become one of it and one above."""
    out, weight = [], 0
    while weighted:
        parts = weighted.pop(weight, [])
        now = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
        above = weighted.setdefault(weight + 1, [])
        while len(now) > 2:
            m = len(now) // 3
            a, b, c, rest = now[:m], now[m : 2 * m], now[2 * m : 3 * m], now[3 * m :]
            ab = a ^ b
            above.append((a & b) | (ab & c))
            now = np.concatenate([ab ^ c, rest]) if len(rest) else ab ^ c
        if len(now) == 2:
            above.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        out.append(now[0] if len(now) else np.zeros(words, np.uint64))
        if not above:
            del weighted[weight + 1]
        weight += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def at_least(total: list[np.ndarray], valid: np.ndarray, limit: int) -> np.ndarray:
    """Bitmap of the valid rows whose sum is `limit` or more."""
    if limit <= 0:
        return valid
    if limit.bit_length() > len(total):
        return np.zeros_like(valid)
    more, same = np.zeros_like(valid), valid
    for k in range(len(total) - 1, -1, -1):
        if limit >> k & 1:
            same = same & total[k]
        else:
            more = more | (same & total[k])
            same = same & ~total[k]
    return more | same


def kth(total: list[np.ndarray], valid: np.ndarray, k: int) -> int:
    """The k-th greatest sum among the valid rows, of which there are k or more."""
    value, above, same = 0, 0, valid
    for j in range(len(total) - 1, -1, -1):
        ones = same & total[j]
        n = count(ones)
        if above + n >= k:
            value |= 1 << j
            same = ones
        else:
            above += n
            same = same & ~total[j]
    return value


def search(query: np.ndarray, own: int, ids: np.ndarray, exact: np.ndarray, bitmaps: np.ndarray | None, dropped: int, k: int) -> tuple[np.ndarray, list[int]]:
    """Ids and exact scores of a block's rows that can be among the query's k best in it."""
    valid_rows = ids != own
    n = int(valid_rows.sum())
    rows = np.flatnonzero(valid_rows)
    if n > k and bitmaps is not None and query.dtype != object:
        width, words = bitmaps.shape[1:]
        bits = np.zeros(words * 64, np.uint8)
        bits[: len(ids)] = valid_rows
        valid = np.packbits(bits, bitorder="little").view(np.uint64)
        size = np.abs(query)
        flipped = bitmaps ^ np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None, None]
        weighted: dict[int, list[np.ndarray]] = {}
        for b in range(int(size.max()).bit_length()):
            chosen = flipped[(size >> b & 1).astype(bool)]
            if len(chosen):
                for j in range(width):
                    weighted.setdefault(b + j, []).append(chosen[:, j])
        total = add_slices(weighted, words)
        slack = -((-((1 << dropped) - 1) * sum(size.tolist())) // (1 << dropped))
        found = at_least(total, valid, kth(total, valid, k) - slack)
        rows = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(ids)])
    chosen = exact[rows]
    if not len(rows):
        return ids[:0], []
    most, asked = int(np.abs(chosen).max()), int(np.abs(query).max())
    if max(most, asked, most * asked * len(query)) < 1 << 62:
        scores = chosen.astype(np.int64) @ query.astype(np.int64)
        order = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows][order], scores[order].tolist()
    scores = (chosen.astype(object) @ query.astype(object)).tolist()
    order = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    return ids[rows[order]], [scores[i] for i in order]


def finite(vector: Column) -> Column:
    """Whether a vector takes part."""
    inf = F.lit(float("inf"))
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x.cast("double") < inf) & (x.cast("double") > -inf))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id, embedding."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                for dim, (all_ids, x) in vectors_of(batch.slice(start, BLOCK)).items():
                    kinds = by_kind(x)
                    for kind in np.unique(kinds).tolist():
                        ids, own = all_ids[kinds == kind], x[kinds == kind]
                        bitmaps, dropped = None, 0
                        if kind != RAW:
                            own = integers(own)
                            bitmaps, _, dropped = slices_of(own)
                        raw = own.astype(np.int32) if kind == SMALL else own
                        kept = bitmaps.tobytes() if bitmaps is not None and dropped < TOO_MANY else None
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([serial]), pa.array([dim]), pa.array([kind]), pa.array([ids.tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary()), pa.array([kept], pa.binary()), pa.array([dropped])],
                            ["block", "dim", "kind", "ids", "exact", "bitmaps", "dropped"],
                        )
                        serial += 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                for dim, (ids, x) in vectors_of(batch.slice(start, QUERY_BLOCK)).items():
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "query_ids", "query"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, kind, dropped = (batch.column(i)[row].as_py() for i in (0, 1, 5))
                ids, query_ids = (np.frombuffer(batch.column(i)[row].as_buffer(), np.int64) for i in (2, 6))
                exact = np.frombuffer(batch.column(3)[row].as_buffer(), (np.int32, np.int64, np.float64)[kind]).reshape(-1, dim)
                exact = integers(exact) if kind == RAW else exact
                bitmaps = batch.column(4)[row].as_buffer()
                if bitmaps is not None:
                    bitmaps = np.frombuffer(bitmaps, np.uint64).reshape(dim, -1, -(-len(ids) // 64))
                query = np.frombuffer(batch.column(7)[row].as_buffer(), np.float64).reshape(-1, dim)
                found = [search(integers(q[None])[0], int(i), ids, exact, bitmaps, dropped, k) for q, i in zip(query, query_ids, strict=True)]
                scores = [s for _, own in found for s in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, [len(i) for i, _ in found])), pa.array(np.concatenate([i for i, _ in found])),
                        pa.array([max(-LONG, min(LONG - 1, s)) for s in scores], pa.int64()), pa.array([-LONG <= s < LONG for s in scores], pa.bool_()),
                    ],
                    ["query_id", "vec_id", "score", "fits"],
                )

    built = vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(index, "block bigint, dim bigint, kind bigint, ids binary, exact binary, bitmaps binary, dropped bigint")
    built = materialise(built, "slices")
    asked = queries.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    asked = materialise(asked.mapInArrow(blocks, "dim bigint, query_ids binary, query binary"), "queries")
    cells = max(1, min(built.count(), CELLS * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))))
    met = built.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))).join(spread.hint("shuffle_merge"), ["cell", "dim"])
    met = met.select("dim", "kind", "ids", "exact", "bitmaps", "dropped", "query_ids", "query")
    best = met.mapInArrow(meet, "query_id bigint, vec_id bigint, score bigint, fits boolean")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    too_large = F.raise_error(F.concat(F.lit("the score of query "), F.col("query_id"), F.lit(" and row "), F.col("vec_id"), F.lit(" does not fit a long"))).cast("bigint")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.when(F.col("fits"), F.col("score")).otherwise(too_large).alias("score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
    from embeddings
    where embedding is not null and vec_id is not null
      and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), q as (select * from v where vec_id % 100 = 0),
s as (
    select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
    from q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 10
"""
