"""Op 5: chat formatting by quotation linking.

A line's quote level is its number of leading '>' marks. Lines of level 0 are a message's own text. An attribution line
("... wrote:") that stands before a deeper level is no text of its own level, whatever that is. Consecutive quoted lines of
one level are a passage; lines are normalised (marks off, lower case, single spaces), blank ones go. A message holds a passage
if the passage's lines stand in its own text one after the other, blank lines aside, so parts of paragraphs and several
paragraphs link as well as whole messages. A passage that a client has wrapped anew is held by a message whose whole text, or
paragraph, has the same words.

Passages are joined to messages by hashes: of a run of lines a message sends the hashes of all runs of as many lines as any
passage has, and of its paragraphs and whole text the hashes of their words. A passage links to the latest earlier message of
the conversation that holds it, else to the least message of the least conversation that holds it, if that is another
conversation. What a message replies to is the target of its first passage that links inside the conversation; a nested quote
comes after what quotes it only if it stands there, so replies hang under what they answer, not under what that quotes.

Threads: roots follow by pointer doubling. Replies are put in order by a walk of the reply tree (a message, then its replies
by turn, each with its own replies first): the walk's places are ranks in a list of steps into and out of messages, found by
pointer doubling, so no conversation is gathered. Ordered by (conv_id, root_turn, place), a thread reads as such a walk.

The link is an as-of join in two steps, within blocks of turns and over the blocks' maxima, so no message set of a
conversation meets in one task, however long the conversation or common the passage.

Null text: empty. Null conv_id or turn: the row stays, links to nothing and is its own root. Repeated (conv_id, turn) rows
stay and share their links. Very long texts are parsed whole. An empty table gives an empty table. Columns other than conv_id,
turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, slices, table, texts

MARKS = re.compile(r"[ \t]{0,3}>(?:[ \t]?>)*[ \t]?")
#: Verbs that end an attribution line.
VERBS = ("wrote", "schrieb", "écrit", "escribió")
ATTRIBUTION = re.compile(rf"\b(?:{'|'.join(VERBS)})\s?:$", re.I)
#: Turns to a block of the as-of join.
TURNS = 256
MAX_ROUNDS = 60
FACTOR = 0x9E3779B97F4A7C15
WRAP = 1 << 64


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode(), 7)


def signed(n: int) -> int:
    return n - WRAP if n >> 63 else n


def run_hash(lines: list[str]) -> int:
    """The hash of a run of lines."""
    h = 0
    for line in lines:
        h = (h * FACTOR + digest(line)) % WRAP
    return signed(h ^ len(lines))


def words_hash(lines: list[str]) -> int:
    """The hash of the words of some lines, wherever the lines break."""
    return signed(digest("\n" + " ".join(lines)))


def run_hashes(lines: list[str], sizes: list[int]) -> np.ndarray:
    """The hashes of all runs of these numbers of lines, by one polynomial over all lines."""
    own = np.fromiter(map(digest, lines), np.uint64, len(lines))
    found = []
    for n in sizes:
        if n > len(lines):
            continue
        if n == 1:
            h = own.copy()
        else:  # prefix[i + n] - prefix[i] * FACTOR ** n
            prefix = np.zeros(len(lines) + 1, np.uint64)
            h = 0
            for i, x in enumerate(own.tolist()):
                h = (h * FACTOR + x) % WRAP
                prefix[i + 1] = h
            h = prefix[n:] - prefix[:-n] * np.uint64(pow(FACTOR, n, WRAP))
        found.append(h ^ np.uint64(n))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def is_attribution(line: str) -> bool:
    return bool(ATTRIBUTION.search(line.rstrip()[-80:]))


def parse(text: str) -> tuple[str, list[str], int, list[tuple[int, list[str]]]]:
    """Own text, its normalised lines (a blank one ends a paragraph), deepest quote level, quoted passages (level, lines)."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    before, last = 0, own  # the level and the lines that the line before went to
    for line in text.split("\n"):
        m = MARKS.match(line)
        level = m.group().count(">") if m else 0
        if level > before and last and is_attribution(last[-1]):
            last.pop()
        if not level:
            last = own
        elif level != before or not blocks:
            blocks.append((level, []))
            last = blocks[-1][1]
        last.append(line[m.end() :] if m else line)
        before = level
    quotes = [(level, kept) for level, lines in blocks if (kept := [n for x in lines if (n := normalised(x))])]
    return "\n".join(own).strip("\n") if blocks else text, [normalised(x) for x in own], max((level for level, _ in blocks), default=0), quotes


def paragraphs(lines: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for line in lines:
        if line:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


QUOTE = pa.struct([("ordinal", pa.int32()), ("level", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.int64())])


def parsed(messages: DataFrame) -> DataFrame:
    kinds = dict(messages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [parse(t) for t in texts(batch)]
            quotes = [[{"ordinal": i, "level": a, "size": len(x), "hash": run_hash(x), "words": words_hash(x)} for i, (a, x) in enumerate(f[3])] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array(quotes, pa.list_(QUOTE))],
                ["conv_id", "turn", "role", "own_text", "max_level", "quotes"],
            )

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, own_text string, max_level int, quotes array<struct<ordinal: int, level: int, size: int, hash: bigint, words: bigint>>"
    return messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), "text").mapInArrow(run, schema)


def holdings(made: DataFrame, sizes: list[int]) -> DataFrame:
    """conv_id, turn, hash: what each message's own text holds."""
    kinds = dict(made.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own_text"):
            found = []
            for text in texts(batch, "own_text"):
                lines = [normalised(x) for x in text.split("\n")]
                kept = [x for x in lines if x]
                parts = paragraphs(lines)
                whole = {words_hash(p) for p in parts} | ({words_hash(kept)} if kept else set())
                found.append([*run_hashes(kept, sizes).tolist(), *sorted(whole)])
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([h for f in found for h in f], pa.int64())], ["conv_id", "turn", "hash"])

    return made.select("conv_id", "turn", "own_text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, hash bigint")


def linked(made: DataFrame) -> DataFrame:
    """conv_id, turn, ordinal, level, parent_conv, parent_turn: the target of each quoted passage; null where none is found."""
    quotes = made.where("size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    quotes = quotes.select("conv_id", "turn", "ordinal", "level", "size", F.explode(F.array("hash", "words")).alias("hash"))
    sizes = sorted(r.size_ for r in quotes.select(F.col("size").alias("size_")).distinct().collect())  # bounded by a passage's lines
    wanted = quotes.select("hash").distinct()
    known = made.where("conv_id is not null and turn is not null") if sizes else made.limit(0)
    units = holdings(known, sizes).join(wanted, "hash", "left_semi").distinct()
    key = ["conv_id", "hash"]
    asked = quotes.where("conv_id is not null and turn is not null").select(*key, "turn").distinct()
    events = units.select(*key, "turn", F.col("turn").alias("origin"), F.lit(1).alias("kind")).unionByName(asked.select(*key, "turn", F.lit(None).cast("bigint").alias("origin"), F.lit(0).alias("kind")))
    events = events.withColumn("block", F.floor(F.col("turn") / TURNS))
    within = Window.partitionBy(*key, "block").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("origin").over(within)).where("kind = 0").select(*key, "turn", "block", "near")
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = events.groupBy(*key, "block").agg(F.max("origin").alias("most")).withColumn("far", F.max("most").over(earlier)).select(*key, "block", "far")
    inside = near.join(far, [*key, "block"]).select(*key, "turn", F.coalesce("near", "far").alias("inside"))
    least = units.groupBy("hash").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))).alias("o"))
    found = quotes.join(inside, [*key, "turn"], "left").join(least, "hash", "left")
    found = found.groupBy("conv_id", "turn", "ordinal", "level").agg(F.max("inside").alias("inside"), F.min("o").alias("o"))
    outside = F.col("inside").isNull() & F.col("o").isNotNull() & ~F.col("o.c").eqNullSafe(F.col("conv_id"))
    return found.select(
        "conv_id", "turn", "ordinal", "level",
        F.when(F.col("inside").isNotNull(), F.col("conv_id")).when(outside, F.col("o.c")).alias("parent_conv"),
        F.when(F.col("inside").isNotNull(), F.col("inside")).when(outside, F.col("o.t")).alias("parent_turn"),
    )


def roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth from (conv_id, turn, parent_turn) with parent_turn < turn, by pointer doubling."""
    now = materialise(parents.select("conv_id", "turn", F.col("parent_turn").cast("bigint").alias("root_turn"), F.lit(1).cast("bigint").alias("depth")), "threads")
    for _ in range(MAX_ROUNDS):
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("r"), F.col("depth").alias("d"))
        met = now.join(up, (F.col("conv_id") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
        nxt = materialise(met.select("conv_id", "turn", F.coalesce("r", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "threads")
        discard(now)
        now = nxt
        if nxt.where("moved").limit(1).count() == 0:
            return now
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def places(parents: DataFrame) -> DataFrame:
    """conv_id, turn, place: of each message that replies or is replied to, its place in the walk of its tree, from 0.

    The walk is a list of steps, one into and one out of each message: into a message, into its first reply or out of it, out
    of a message, into the next reply beside it or out of the one above. A step's rank from the end is a sum along the list, by
    pointer doubling; only steps into messages count."""
    beside = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    child = parents.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("parent_turn").cast("bigint").alias("parent_turn")).withColumn("next", F.lead("turn").over(beside))
    first = child.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("first"))
    nodes = child.select("conv_id", "turn").union(child.select("conv_id", "parent_turn")).distinct()
    nodes = nodes.join(first, ["conv_id", "turn"], "left").join(child, ["conv_id", "turn"], "left")
    step = lambda turn, out: F.struct(turn.alias("turn"), F.lit(out).alias("out"))
    into = nodes.select("conv_id", "turn", F.lit(False).alias("out"), F.when(F.col("first").isNotNull(), step(F.col("first"), False)).otherwise(step(F.col("turn"), True)).alias("to"), F.lit(1).cast("bigint").alias("n"))
    outward = nodes.select("conv_id", "turn", F.lit(True).alias("out"), F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("parent_turn").isNotNull(), step(F.col("parent_turn"), True)).alias("to"), F.lit(0).cast("bigint").alias("n"))
    now = materialise(into.union(outward), "walk")
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("conv_id").alias("c"), F.struct("turn", "out").alias("s"), F.col("to").alias("further"), F.col("n").alias("m"))
        met = now.join(ahead, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("s")), "left")
        nxt = materialise(met.select("conv_id", "turn", "out", F.col("further").alias("to"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "walk")
        discard(now)
        now = nxt
        if now.where("to is not null").limit(1).count() == 0:
            return now.where("not out").select("conv_id", "turn", (-F.col("n")).alias("place"))
    raise RuntimeError(f"no end of the walk after {MAX_ROUNDS} rounds")


def conversations(messages: DataFrame) -> DataFrame:
    """A row per message in reply order: conv_id, root_turn, place (in the thread's walk), turn, role, text without quotes,
    rendered (with its role), n_quotes, max_level, parent_conv, parent_turn (of the first passage that links), depth below the root."""
    made = materialise(parsed(messages), "messages")
    targets = materialise(linked(made), "links")
    rank = F.struct(~F.col("parent_conv").eqNullSafe(F.col("conv_id")), "ordinal")
    first = targets.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min_by(F.struct("parent_conv", "parent_turn"), rank).alias("p"))
    first = materialise(first.select("conv_id", "turn", "p.parent_conv", "p.parent_turn"), "parents")
    inside = first.where("parent_conv = conv_id").select("conv_id", "turn", "parent_turn")
    tree, walk = roots(inside), places(inside)
    out = made.withColumn("n_quotes", F.size("quotes").cast("bigint")).join(first, ["conv_id", "turn"], "left").join(tree, ["conv_id", "turn"], "left").join(walk, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("unknown"))
    out = out.select(
        "conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), F.col("place").alias("walked"), "turn", "role", F.col("own_text").alias("text"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own_text")).alias("rendered"),
        "n_quotes", "max_level", "parent_conv", "parent_turn", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
    )
    ends = walk.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("place").alias("start"))  # a root is its walk's first
    out = out.join(ends, (F.col("conv_id") == F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
    place = F.coalesce(F.col("walked") - F.col("start"), F.lit(0)).cast("bigint").alias("place")
    return out.select("conv_id", "root_turn", place, "turn", "role", "text", "rendered", "n_quotes", "max_level", "parent_conv", "parent_turn", "depth").orderBy("conv_id", "root_turn", "place", "turn")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
