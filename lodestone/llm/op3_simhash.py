"""Op 3: SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at 2 or fewer differing bits. At least one half of 32 bits then differs in 1 bit at most.
In each half the anchors are a covering code: the perfect Hamming code on 31 bits (covering radius 1) times one free bit. A
fingerprint has its home at the nearest anchor and visits every anchor within covering radius plus threshold (1 + 1), 16 or
17 of them; what differs from it in 1 bit has its home at one of these. Homes and visitors are compared per anchor.

Equal fingerprints are one node, so copies are never expanded. No words: fingerprint zero, linked like any other. Null text
is empty. A null doc_id keeps its row; a component of null ids only has a null id. Repeated rows and ids keep their rows. Very
long texts are hashed whole, in blocks. An empty table gives an empty table. Other columns may have any names.

The pipeline's stage (one_of_each) has wider bounds: it links texts of five-word Jaccard 0.8 or more as well. Candidates
share a band of four minimal hashes, 20 bands (a pair at 0.8 shares one but once in 38,000 times), and are compared by
their whole sets of shingles: first all of a band with one of them, then what is still apart. It decides by row (id and text), so unlike texts under one id don't stand for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import op4_substring
from .common import discard, in_tasks, materialise, slices, table, texts
from .graph import components

SHINGLE, SEED, BITS = 3, 42, 2
CHUNK = 1 << 14
#: Text bytes that the stage handles at a time: its arrays are many times as large.
SMALL = 2 << 20
#: The stage's link rule and its bands of minimal hashes.
JACCARD, BANDS, ROWS = 0.8, 20, 4
#: Rounds in which a band's texts are compared with one of them, and parts that a text's set is copied to.
ROUNDS, SALTS = 1, 64


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """64 bits of a text in UTF-8: a bit is set if it is set in over half the hashes of the shingles."""
    words = raw.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t.encode()) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_col, "fp"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp bigint")


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Rows of the parity checks over bits 0 to 30 (bit i has the column i + 1), and for each syndrome the flips of at most
    two bits that lead to a codeword, the nearest first; unused places repeat the first."""
    checks = np.array([sum(1 << i for i in range(31) if (i + 1) >> j & 1) for j in range(5)], np.uint32)
    flips = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        found = [1 << (s - 1)]
        found += [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if a < a ^ s]
        flips[s] = found
    return checks, flips


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (which fingerprint, anchor, whether it is its home). An anchor: half, free bit, codeword."""
    checks, flips = _syndromes()
    of, at, home = [], [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)).astype(np.uint32)
        code, free = x & np.uint32(0x7FFFFFFF), (x >> np.uint32(31)).astype(np.int64)
        syndrome = sum(((np.bitwise_count(code & c) & 1).astype(np.int64) << j) for j, c in enumerate(checks))
        near = (code[:, None] ^ flips[syndrome]).astype(np.int64)
        base = np.int64(half) << np.int64(32)
        own = np.repeat(index, 16).reshape(-1, 16)
        once = np.ones(near.shape, bool)
        once[syndrome == 0, 1:] = False
        of += [index, own[once], index]
        at += [base | free << 31 | near[:, 0], (base | free[:, None] << 31 | near)[once], base | (1 - free) << 31 | near[:, 0]]
        home += [np.ones(len(fps), bool), np.zeros(int(once.sum()), bool), np.zeros(len(fps), bool)]
    return np.concatenate(of), np.concatenate(at), np.concatenate(home)


def links(nodes: DataFrame, name: str = "links") -> DataFrame:
    """Edges (u, v), u < v, between distinct fingerprints `fp` of nodes at most BITS bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for k in range(0, len(fps), CHUNK):
                part = fps[k : k + CHUNK]
                of, at, home = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[of]), pa.array(home)], ["anchor", "fp", "home"])

    spread = nodes.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")
    homes = in_tasks(spread.where("home").select("anchor", F.col("fp").alias("u")))
    visits = spread.where("not home").select("anchor", F.col("fp").alias("v"))
    return homes.join(visits, "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS)).select("u", "v")


def _rooted(prints: DataFrame, id_col: str) -> DataFrame:
    """fp, least, root: each fingerprint with its least id and the least fingerprint that links reach."""
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes), "simhash").withColumnsRenamed({"node": "fp"})
    return nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the least id that links reach."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(prints, id_col)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the pipeline's stage ---------------------------------------------------------------------------------------------


def words_key(text: str) -> int:
    """A digest of a text's words."""
    n = xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), SEED + 1)
    return n - (1 << 64) if n >> 63 else n


def bands(rows: list[str]) -> list[list[int]]:
    """For each text its bands of minimal hashes of five-word shingles; none for a text of fewer words."""
    h, which, _ = op4_substring.shingles(*op4_substring.word_hashes(rows))
    out: list[list[int]] = [[] for _ in rows]
    if not len(h):
        return out
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    mixers = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS, 2), np.uint64)
    found = np.empty((len(starts), BANDS), np.uint64)
    for i in range(BANDS):
        band = np.full(len(starts), i, np.uint64)
        for salt, factor in mixers[i]:
            band = op4_substring.mix(band) + np.minimum.reduceat((h ^ salt) * (factor | np.uint64(1)), starts)
        found[:, i] = op4_substring.mix(band)
    for i, own in zip(which[starts].tolist(), found.view(np.int64).tolist(), strict=True):
        out[i] = own
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a hash of the text), fp, key of the words, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            rows = texts(batch)
            fps = np.array([fingerprint(t.encode()) for t in rows], np.uint64).view(np.int64)
            keys = pa.array([words_key(t) for t in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps), keys, pa.array(bands(rows), pa.list_(pa.int64()))], ["id", "row", "fp", "key", "bands"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), row_key(docs[text_col]).alias("row")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, row bigint, fp bigint, key bigint, bands array<bigint>")


def row_key(text: Column) -> Column:
    """What tells rows under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(docs: DataFrame, one_row: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, words (sorted distinct shingle hashes of four bytes, packed) of the texts with these keys; one_row: id and row of one text of each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            rows = texts(batch)
            h, which, _ = op4_substring.shingles(*op4_substring.word_hashes(rows))
            h = (h >> np.uint64(32)).astype("<u4")
            edges = np.searchsorted(which, np.arange(len(rows) + 1))
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([words_key(t) for t in rows], pa.int64()), pa.array(sets, pa.binary())], ["key", "words"])

    chosen = docs.select(docs[id_col].alias("id"), row_key(docs[text_col]).alias("row"), docs[text_col].alias("text")).join(one_row, ["id", "row"], "left_semi").select("text")
    return chosen.mapInArrow(pack, "key bigint, words binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])


def shared_sizes(sets: DataFrame) -> DataFrame:
    """key, size (of its set), shared (how many of its shingles another set has as well)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sets = [np.frombuffer(words.as_buffer(), "<i4") for words in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(part.column(0).to_numpy(), list(map(len, sets))))], ["h", "key"])

    alone = sets.select("key", "words").mapInArrow(spread, "h int, key bigint").groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    counts = alone.groupBy("key").agg(F.count("*").alias("alone"))
    size = (F.octet_length("words") / 4).cast("bigint")
    return sets.select("key", size.alias("size")).join(counts, "key", "left").select("key", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of pairs (key, other, u, v) whose sets have a Jaccard of JACCARD or more. `other` may be in very many pairs: its set
    is copied to SALTS parts of them at most."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                small, large = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= JACCARD * large - 1e-9 else 0
                good.append(both >= JACCARD * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["u", "v"])

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    copies = salted.select("other", "salt").distinct().join(sets.select(F.col("key").alias("other"), F.col("words").alias("other_words")), "other")
    met = in_tasks(salted).join(sets.select("key", "words"), "key").join(copies, ["other", "salt"]).select("u", "v", "words", "other_words")
    return met.mapInArrow(compare, "u bigint, v bigint").distinct()


def telling_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, other, u, v): the pairs of members (pivot, key, part) of a pivot, in different parts, that may have a Jaccard of
    JACCARD or more.

    Let D be a text's difference from the pivot c, either way. Texts x, y are alike if their difference, |Dx| + |Dy| - 2 |Dx & Dy|,
    is a (|x| + |y|) at most, a = (1 - J) / (1 + J). All have been compared with c, so of two in different parts one, y, is not alike to it, so |Dy| > a (|y| + |c|), and Dx
    and Dy have more than (|Dx| - a |x| + a |c|) / 2 in common. So one of the first |Dx| less that many of Dx, in any order, is in
    Dy. In the order taken, what c lacks comes first: copies of c with edits of their own share little of that, so a group of them,
    however large, makes few pairs."""
    ratio = (1 - JACCARD) / (1 + JACCARD)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for i, (x, c) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                x, c = np.frombuffer(x.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<i4")
                more, less = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                d = np.r_[more, less]
                both = len(x) - len(more)
                apart = both < JACCARD * (len(x) + len(c) - both) - 1e-9
                first = int(np.ceil((len(d) + ratio * (len(x) - len(c))) / 2 + 1e-9))
                n = len(d) if apart else max(0, min(first, len(d)))
                place = np.arange(n)
                rows.append([np.full(n, i), np.full(n, len(x)), np.full(n, len(d)), np.full(n, apart), place < first, place, d[:n]])
            of, size, d, apart, first, place, h = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 7
            of = pa.array(of.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(of) for i in range(3)), *(pa.array(c.astype(np.int32)) for c in (size, d)), *(pa.array(c.astype(bool)) for c in (apart, first)), *(pa.array(c.astype(np.int32)) for c in (place, h))],
                ["pivot", "key", "part", "size", "d", "apart", "first", "place", "h"],
            )

    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    copies = salted.select("pivot", "salt").distinct().join(sets.select(F.col("key").alias("pivot"), F.col("words").alias("centre")), "pivot")
    met = salted.join(sets.select("key", "words"), "key").join(copies, ["pivot", "salt"]).select("pivot", "key", "part", "words", "centre")
    rows = materialise(met.mapInArrow(differences, "pivot bigint, key bigint, part bigint, size int, d int, apart boolean, first boolean, place int, h int"), "differences")
    left = rows.where("first").select("pivot", "h", "key", "part", "size", "d", "place")
    right = rows.where("apart").select("pivot", "h", *(F.col(c).alias(f"other_{c}") for c in ("part", "size", "d")), F.col("key").alias("other"))
    needed = (F.col("d") + F.col("other_d") - ratio * (F.col("size") + F.col("other_size"))) / 2 - 1e-9
    pairs = in_tasks(left).join(right, ["pivot", "h"]).where((F.col("part") != F.col("other_part")) & (F.col("d") - F.col("place") >= needed))
    return pairs.select("key", "other", F.least("part", "other_part").alias("u"), F.greatest("part", "other_part").alias("v")).distinct()


def alike(docs: DataFrame, prints: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (u, v) that join all roots of texts linked by a Jaccard of JACCARD or more.

    Candidates share a band. A text can only be linked if others have enough of its shingles, and only with a text of which the
    same holds, so texts whose edits are their own are no candidates, however many others they resemble. The rest is compared
    with centres: all texts of a family, which bands connect, with that of the fewest shingles of its own; then, in rounds, in each
    band with the like of what is still apart. Of what that leaves apart, pairs are compared that share enough of what sets them
    off from their family's centre."""
    one = prints.groupBy("key").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("id", "row")).alias("r")).join(rooted.select("fp", "root"), "fp")
    one = materialise(one.select("key", "root", "r", "bands"), "one")

    def live(rows: DataFrame, part: str) -> DataFrame:
        """The rows of bands that still hold several parts."""
        return rows.join(rows.groupBy("band").agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a < b").select("band"), "band", "left_semi")

    candidates = materialise(live(one.select("key", "root", F.explode("bands").alias("band")), "root"), "candidates")
    wanted = candidates.select("key").distinct()
    full = materialise(shingle_sets(docs, one.join(wanted, "key", "left_semi").select("r.id", "r.row"), wanted, id_col, text_col), "shingles")
    sets = materialise(full.join(shared_sizes(full).where(F.col("shared") >= JACCARD * F.col("size") - 1e-9), "key"), "sets")
    ratio = (F.col("size") - F.col("shared")) / F.col("size")
    now = materialise(live(candidates.join(sets.select("key", "size", "shared"), "key"), "root").withColumnRenamed("root", "part").withColumn("near", F.lit(False)), "candidates")
    discard(one, candidates, full)

    # texts that bands connect are a family; all of one are compared with its centre
    bound = components(now.join(now.groupBy("band").agg(F.min("key").alias("v")), "band").select(F.col("key").alias("u"), "v"), "families").withColumnsRenamed({"node": "key", "root": "family"})
    texts_of = now.select("key", "part", ratio.alias("own")).distinct().join(bound, "key")
    middle = texts_of.groupBy("family").agg(F.min(F.struct("own", "key", "part")).alias("c")).select("family", F.col("c.key").alias("pivot"), F.col("c.part").alias("pivot_part"))
    members = materialise(texts_of.join(middle, "family").select("key", "part", "pivot", "pivot_part"), "members")
    apart = members.where("part <> pivot_part").select("key", F.col("pivot").alias("other"), F.least("part", "pivot_part").alias("u"), F.greatest("part", "pivot_part").alias("v"))
    found = [materialise(verified(apart, sets), "edges")]
    roots = components(found[0], "alike").withColumnsRenamed({"node": "part", "root": "joined"})
    middles = roots.withColumnsRenamed({"part": "pivot_part", "joined": "pivot_joined"})
    renamed = members.join(roots, "part", "left").join(middles, "pivot_part", "left").select("key", F.coalesce("joined", "part").alias("now_part"), F.coalesce("pivot_joined", "pivot_part").alias("middle"))
    before, now = now, materialise(live(now.drop("part", "near").join(renamed, "key").select("band", "key", F.col("now_part").alias("part"), "size", "shared", (F.col("now_part") == F.col("middle")).alias("near")), "part"), "candidates")
    discard(before)
    for _ in range(ROUNDS):
        own = F.struct("near", ratio.alias("own"), F.col("key").alias("key"), F.col("part").alias("part"))
        centre = now.groupBy("band").agg(F.min(own).alias("c")).select("band", F.col("c.key").alias("other"), F.col("c.part").alias("other_part"))
        met = materialise(now.join(centre, "band"), "met")
        pairs = met.where("part <> other_part").select("key", "other", F.least("part", "other_part").alias("u"), F.greatest("part", "other_part").alias("v")).distinct()
        edges = materialise(verified(pairs, sets), "edges")
        found.append(edges)
        roots = components(edges, "alike").withColumnsRenamed({"node": "part", "root": "joined"})
        centres = roots.withColumnsRenamed({"part": "other_part", "joined": "other_joined"})
        rest = met.where("key <> other").join(roots, "part", "left").join(centres, "other_part", "left")
        part, other_part = F.coalesce("joined", "part"), F.coalesce("other_joined", "other_part")
        rest = rest.select("band", "key", part.alias("part"), "size", "shared", (F.col("near") | (part == other_part)).alias("near"))
        before, now = now, materialise(live(rest, "part"), "candidates")
        discard(before, met)
    left = now.select("key", "part").distinct().join(members.select("key", "pivot"), "key")
    out = verified(materialise(telling_pairs(left.select("pivot", "key", "part"), sets), "pairs"), sets)
    for edges in found:
        out = out.unionByName(edges)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of both link rules stays: the one with the least id, and of texts that share this id
    the one whose hash is least; of rows equal in both the first by all columns. Rows with a null id are left alone."""
    known = docs.where(docs[id_col].isNotNull())
    prints = materialise(sketches(known, id_col, text_col), "sketches")
    rooted = materialise(_rooted(prints, "id"), "rooted")
    wider = components(alike(known, prints, rooted, id_col, text_col), "alike").select(F.col("node"), F.col("root").alias("wide"))
    found = rooted.join(wider, rooted["root"] == wider["node"], "left").select("fp", F.coalesce("wide", "root").alias("component"))
    least = prints.groupBy("fp").agg(F.min(F.struct("id", "row")).alias("first"))
    keepers = materialise(least.join(found, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.row"), "keepers")
    discard(prints, rooted)
    order = Window.partitionBy("id", "row").orderBy(*(F.xxhash64(F.col("document").getField(c)) for c in docs.columns))
    rows = known.select(known[id_col].alias("id"), row_key(known[text_col]).alias("row"), F.struct(*(known[c] for c in docs.columns)).alias("document"))
    first = rows.join(keepers, ["id", "row"], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select("document.*").unionByName(docs.where(docs[id_col].isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
