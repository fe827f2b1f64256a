"""Op 9: byte-level BPE by a pair occurrence index.

All new distinct words of a batch are laid end to end. An index maps each adjacent pair to the positions where it stands.
Ranks that are active are applied in ascending order, each to all its positions at once; a merge looks up only the pairs at
its own two borders and adds their positions to the lists of their ranks. A pair that holds a new token ranks after the
merge that made the token, so each rank is applied once.

Words are cut by the pattern of the vocabulary's pre-tokenizer. Code points whose classes differ from the library's Unicode
version are found by asking the library about each once; texts with these, or with any above U+FFFF, are cut by the library's
pre-tokenizer.

Result per document: ids as the tokenizers library gives them, and their decoding. A null text is empty; an empty text has
no ids. Strings of special tokens inside a text are special tokens, which is the library's default. Null ids, repeated rows
and ids keep their rows. Very long texts are encoded whole. An empty table gives an empty table. Other columns may have any
names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts

#: Words that stay in a worker's cache, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Bits of a token id in a pair's key.
SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spans_of(library, text: str) -> list[tuple[int, int]]:
    """Where the library's pre-tokenizer cuts a text."""
    return [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]


POINTS = 0x10000
_found: dict[tuple, str] = {}


def unlike_classes(library, pattern: str, points: Iterable[int]) -> set[int]:
    """Code points beside which the library cuts in other places than the pattern does here."""
    words, found = regex.compile(pattern), set()
    for c in points:
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}{chr(c)}a {chr(c)}1"
            if [s[a:b] for a, b in spans_of(library, s)] != words.findall(s):
                found.add(c)
    return found


def char_class(points: set[int]) -> str:
    """A character class of these code points and all above U+FFFF."""
    ends = sorted(points)
    starts = [c for c in ends if c - 1 not in points]
    stops = [c for c in ends if c + 1 not in points]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, stops, strict=True)) + "\U00010000-\U0010ffff]"


def probed(probe: Callable[[str, Iterable[int]], set[int]], path: str, spark: SparkSession | None = None) -> str:
    """A class of the code points up to U+FFFF that a probe names, and all above. With a session the executors ask; what they
    return is some thousand numbers at most, the same for any data."""
    key = (probe.__module__, probe.__name__, path)
    if key not in _found:
        if spark is None:
            points = probe(path, range(POINTS))
        else:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(probe(path, batch.column(0).to_pylist())), pa.int64())], ["id"])

            points = {r.id for r in spark.range(0, POINTS, 1, 8).mapInArrow(run, "id bigint").collect()}
        _found[key] = char_class(points)
    return _found[key]


def unlike(path: str, points: Iterable[int]) -> set[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    return unlike_classes(Tokenizer.from_file(path), public_tokenizers.PATTERN, points)


class ByteBpe:
    def __init__(self, path: str, pattern: str, rare: str | None = None):
        self.path, self._library = path, None
        self.rare = re.compile(rare or probed(unlike, path)).search
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = (self.left << SHIFT) | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.first = np.full((256, 256), -1, np.int32)
        back = {int(i): b for b, i in enumerate(self.byte_id)}
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            if a in back and b in back:
                self.first[back[a], back[b]] = r
        self.findall = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not self.rare(text):
            return self.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return [text[a:b] for a, b in spans_of(self._library, text)]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(lengths)
        symbols = self.byte_id[raw]
        last = np.zeros(n + 1, bool)  # the last symbol of its word has no right neighbour
        last[ends[lengths > 0] - 1] = True
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        has_next = ~last[:n]
        has_prev = np.ones(n, bool)
        has_prev[(ends - lengths)[lengths > 0]] = False
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
            for r, part in zip(ranks[starts].tolist(), np.split(positions, starts[1:]), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        if n > 1:
            pairs = np.flatnonzero(has_next)
            add(pairs, self.first[raw[pairs], raw[pairs + 1]])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & has_next[at]]
            at = at[(symbols[at] == a) & (symbols[following[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping pairs the leftmost go first
                chained = np.r_[False, following[at[:-1]] == at[1:]]
                begins = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbols[at] = self.made[r]
            alive[gone] = False
            after = following[gone]
            following[at] = after
            has_next[at] = has_next[gone]
            inner = has_next[at]
            before[after[inner]] = at[inner]
            left = before[at[has_prev[at]]]
            both = np.unique(np.concatenate([left, at[inner]]))
            if len(both):
                add(both, self.rank_of(symbols[both], symbols[following[both]]))
        kept = symbols[alive].astype("<u4").tobytes()
        counts = np.add.reduceat(np.r_[alive, False].astype(np.int64), np.minimum(ends - lengths, n)) if n else np.zeros(len(words), np.int64)
        counts[lengths == 0] = 0
        to = np.cumsum(counts) * 4
        return [kept[e - c : e] for e, c in zip(to.tolist(), (counts * 4).tolist(), strict=True)]

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else (t,) for t in batch]
        found = [[[p] if j % 2 else self.words(p) for j, p in enumerate(parts)] for parts in split]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new: set[str] = set()
        for parts in found:
            for words in parts[::2]:
                new.update(words)
        new.difference_update(self.cache)
        fresh = list(new)
        ids = dict(zip(fresh, self.merge_words([w.encode() for w in fresh]), strict=True))
        if len(ids) < CACHE_WORDS:
            self.cache.update((w, x) for w, x in ids.items() if len(w) <= CACHE_CHARS)
            get = {w: x for w, x in ids.items() if len(w) > CACHE_CHARS}
        else:
            get = ids
        special = {s: int(i).to_bytes(4, "little") for s, i in self.special.items()}
        cache = self.cache

        def packed(words: list[str]) -> bytes:
            if not get:
                return b"".join([cache[w] for w in words])
            return b"".join([get[w] if w in get else cache[w] for w in words])

        return [b"".join(special[p[0]] if j % 2 else packed(p) for j, p in enumerate(parts)) for parts in found]

    def decode(self, packed: bytes) -> bytes:
        """The decoded text in UTF-8; what isn't valid UTF-8 becomes U+FFFD as in the library."""
        whole = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return whole.decode("utf-8", "replace").encode()


_coders: dict[str, ByteBpe] = {}


def coder(path: str | None = None, rare: str | None = None) -> ByteBpe:
    """One coder a worker; path None: the public byte_bpe_50k.json."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _coders:
        _coders[path] = ByteBpe(path, public_tokenizers.PATTERN, rare)
    return _coders[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids (array<int>) and the decoded text."""
    import public_tokenizers

    rare = probed(unlike, path or public_tokenizers.path("byte_bpe_50k.json"), docs.sparkSession)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, rare)
        for batch in slices(batches, "text", 4 << 20):
            packed = bpe.encode_batch(texts(batch))
            decoded = [bpe.decode(x) for x in packed]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in packed], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
