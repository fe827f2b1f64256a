"""Op 8: exact token counts at every prefix, by dynamic programming over prefixes.

The vocabulary marks word ends, so a prefix of a word has two readings. `open`: the last symbol has no end mark. For each
prefix there is one last token t that fits the last token of the prefix before t; count = count there + 1. `closed`: the
prefix ends the text, its last symbol has the end mark; its last token is one with the mark that fits an open prefix.
Two tokens fit if no merge across their border comes before the merges that build their sides of it. Counts at prefixes
of a whole text are sums over its words plus the closed count in the word that the prefix cuts.

Each document's counts at all prefixes are stored as packed steps from one prefix to the next; totals, truncation points and
budgets are read off them, without a second encoding. A prefix is one of the normalised text (NFC, white space to single
spaces, lower case), in which special strings stand as they are. They count as one token each, which is the library's
default; a special string that the prefix cuts is ordinary text.

Character classes, lower case and normal forms are those of the library's Unicode version: code points on which another table
could differ (`unlike`) are found by asking the library about each once, and texts with such go through its normaliser and
pre-tokenizer.

Null text: empty, 0 tokens. Null ids, repeated rows and ids keep their rows. Very long texts are handled whole. An empty table
gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts
from .op9_bpe import byte_alphabet, probed, spans_of, unlike_classes

CACHE_WORDS, CACHE_CHARS, CACHE_FITS = 1_200_000, 48, 1_000_000
LIMIT = 2048
#: Text bytes at a time: new words of a batch share the work on their prefixes.
BATCH_TEXT = 8 << 20
#: The word rule of the vocabulary file's pre-tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NEVER, ONE = 1 << 30, [1]
SIGMA, SMALL_SIGMA = "Σ", "σ"


def fold(text: str) -> str:
    """NFC and lower case by code point, so without a rule for a final sigma."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace(SIGMA, SMALL_SIGMA).lower()


def unlike(path: str, points: Iterable[int]) -> set[int]:
    """Code points on which Python's tables may differ from the library's: those that Unicode 3.2 lacks, as rules for sequences
    may be later (for the others normal forms are stable), and those of which the library's own answers differ."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    found = unlike_classes(library, WORD, points)
    for c in points:
        s = chr(c)
        if unicodedata.ucd_3_2_0.category(s) == "Cn" or (" " if s.isspace() else fold(s)) != library.normalizer.normalize_str(s):
            found.add(c)
    return found


class WordBpe:
    def __init__(self, path: str, rare: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet, end = spec["model"]["vocab"], byte_alphabet(), spec["model"]["end_of_word_suffix"]
        self.path, self._library = path, None
        self.rare = re.compile(rare or probed(unlike, path)).search
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.findall = regex.compile(WORD).findall
        self.spaces = regex.compile(r"\s+")

        def plain(token: str) -> tuple[bytes, bool]:
            closed = token.endswith(end) and len(token) > len(end)
            return bytes(alphabet[c] for c in (token[: -len(end)] if closed else token)), closed

        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        reachable = set(alphabet) | {c + end for c in alphabet}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            reachable.add(a + b)
            self.pair[vocab[a], vocab[b]] = rank
            self.parts.setdefault(vocab[a + b], (rank, vocab[a], vocab[b]))
        for token in reachable:
            if token in vocab:
                raw, closed = plain(token)
                (self.closed if closed else self.open)[raw] = vocab[token]
        self.fits_memo: dict[int, bool] = {}
        #: By chunk (text without white space) the steps of its counts, one byte for each code point; None if a step needs more.
        self.chunks: dict[str, bytes | None] = {}
        # by the last three or two bytes, the lengths that tokens with this end have, longest first; else only bytes fit
        self.open_lengths, self.closed_lengths = self._lengths(self.open), self._lengths(self.closed)

    @staticmethod
    def _lengths(tokens: dict[bytes, int]) -> dict[bytes, list[int]]:
        found: dict[bytes, set[int]] = {}
        for raw in tokens:
            if len(raw) > 1:
                found.setdefault(raw[-3:], {1}).add(len(raw))
        for tail, sizes in found.items():
            if len(tail) == 3 and tail[1:] in tokens:
                sizes.add(2)
        return {k: sorted(v, reverse=True) for k, v in found.items()}

    # --- the recursion ---

    def fits(self, u: int, v: int) -> bool:
        """Whether u, v stand side by side in an encoding: no merge across the border comes first."""
        key = u << 20 | v
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) > CACHE_FITS:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._fits(u, v)
        return known

    def _fits(self, u: int, v: int) -> bool:
        # what stands left of the border, from the whole token inward, each with the rank that builds it into the next
        left, until = [], NEVER
        while True:
            left.append((u, until))
            if u not in self.parts:
                break
            until, _, u = self.parts[u]
        right, until = [], NEVER
        while True:
            right.append((v, until))
            if v not in self.parts:
                break
            until, v, _ = self.parts[v]
        i, j = len(left) - 1, len(right) - 1
        while True:  # forward in time: the side that is built on first moves first
            (a, a_until), (b, b_until) = left[i], right[j]
            rank = self.pair.get((a, b))
            # on a tie with the left side its own merge stands further left and goes first; on the right this one does
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if a_until <= b_until:
                if a_until == NEVER:
                    return True
                i -= 1
            else:
                j -= 1

    def grow(self, word: bytes, last: list[int], count: list[int], closed: list[int]) -> None:
        """The last tokens and counts of a word's open prefixes and the counts of its closed ones, by length in bytes (inside a
        code point: -1). The lists hold those of some shorter prefixes already."""
        open_get, closed_get, memo = self.open.get, self.closed.get, self.fits_memo
        open_lengths, closed_lengths = self.open_lengths.get, self.closed_lengths.get
        n = len(word)
        for i in range(min(len(last), len(closed)), n + 1):
            three, two = word[i - 3 : i] if i > 2 else word[:i], word[i - 2 : i]
            if i == len(closed):
                if i < n and word[i] & 0xC0 == 0x80:
                    closed.append(-1)
                else:
                    for size in closed_lengths(three) or closed_lengths(two) or ONE:
                        if size < i:
                            t = closed_get(word[i - size : i])
                            if t is not None:
                                u = last[i - size]
                                fit = memo.get(u << 20 | t)
                                if self.fits(u, t) if fit is None else fit:
                                    closed.append(count[i - size] + 1)
                                    break
                        elif size == i and word[:i] in self.closed:
                            closed.append(1)
                            break
            if i == len(last) and i < n:
                for size in open_lengths(three) or open_lengths(two) or ONE:
                    if size < i:
                        t = open_get(word[i - size : i])
                        if t is not None:
                            u = last[i - size]
                            fit = memo.get(u << 20 | t)
                            if self.fits(u, t) if fit is None else fit:
                                last.append(t)
                                count.append(count[i - size] + 1)
                                break
                    elif size == i:
                        t = open_get(word[:i])
                        if t is not None:
                            last.append(t)
                            count.append(1)
                            break

    def prefixes(self, words: set[str]) -> dict[str, list[int]]:
        """For distinct words the closed counts at the ends of their code points. In sorted order a word takes over all that
        it shares with the one before."""
        found, last, count, closed, before = {}, [-1], [0], [0], b""
        for raw, word in sorted([(w.encode(), w) for w in words]):
            n, k = len(raw), 0
            most = min(n, len(closed) - 1)
            while k < most and raw[k] == before[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :], closed[k + 1 :]
            self.grow(raw, last, count, closed)
            found[word] = closed[1:] if len(word) == n else [c for c in closed[1:] if c >= 0]
            before = raw
        return found

    # --- texts ---

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def normalise(self, text: str) -> str:
        """The normalised text; `text` holds no special strings."""
        return self.library.normalizer.normalize_str(text) if self.rare(text) else fold(self.spaces.sub(" ", text))

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk of a normalised text."""
        return [chunk[a:b] for a, b in spans_of(self.library, chunk)] if self.rare(chunk) else self.findall(chunk)

    def steps(self, chunks: set[str]) -> dict[str, list[int]]:
        """For distinct chunks the steps of the counts at their prefixes, one for each code point."""
        split = {c: self.words(c) for c in chunks}
        wanted = {w for own in split.values() for w in own}
        # a contraction that is cut is no contraction: an apostrophe, then letters
        wanted |= {w for own in split.values() for x in own if x[0] == "'" and len(x) > 1 for w in ("'", x[1:])}
        counts = self.prefixes(wanted)
        out = {}
        for chunk, own in split.items():
            if len(own) == 1 and own[0][0] != "'":
                found = counts[own[0]]
                out[chunk] = list(map(sub, found, [0, *found]))
                continue
            at, found = 0, []
            for w in own:
                inner = counts[w]
                if w[0] == "'" and len(w) > 1 and w[1].isalpha():
                    inner = [counts["'"][0], *(counts["'"][0] + c for c in counts[w[1:]][:-1]), inner[-1]]
                found += [c + at for c in inner]
                at = found[-1]
            out[chunk] = list(map(sub, found, [0, *found]))
        return out

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn, text first and last."""
        return self.cut.split(text) if "<|" in text else [text]

    def divided(self, text: str) -> list[tuple[bool, list[str], bool]]:
        """For each segment whether white space leads, its chunks, and whether white space ends it; special strings alike."""
        out = []
        for i, part in enumerate(self.segments(text)):
            if i % 2:
                out.append((False, [part], False))
            elif not part:
                out.append((False, [], False))
            elif self.rare(part):
                norm = self.library.normalizer.normalize_str(part)
                out.append((norm[0] == " ", [c for c in norm.split(" ") if c], norm[-1] == " "))
            else:
                out.append((part[0].isspace(), fold(part).split(), part[-1].isspace()))
        return out

    def batch_steps(self, batch: list[str]) -> list[np.ndarray]:
        """For each text the steps of its counts: int8, or int32 where a step needs more."""
        split = [self.divided(t) for t in batch]
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        cache = self.chunks
        new = {c for own in split for i, (_, chunks, _) in enumerate(own) if i % 2 == 0 for c in chunks if c not in cache}
        for own in split:
            for i in range(1, len(own), 2):  # a special string after text that it touches, read as ordinary text
                new.add(self.joined(own, i))
        wide: dict[str, list[int]] = {}
        narrow: dict[str, bytes] = {}
        for chunk, found in self.steps(new).items():
            try:
                narrow[chunk] = array("b", found).tobytes()
            except OverflowError:
                wide[chunk] = found
        kept = {c: x for c, x in narrow.items() if len(c) <= CACHE_CHARS}
        cache.update(kept)
        other = {c: x for c, x in narrow.items() if len(c) > CACHE_CHARS}
        return [self.assemble(own, cache, other, wide) for own in split]

    @staticmethod
    def joined(own: list[tuple[bool, list[str], bool]], i: int) -> str:
        _, chunks, ended = own[i - 1]
        return ("" if ended or not chunks else chunks[-1]) + own[i][1][0]

    def assemble(self, own: list, cache: dict[str, bytes], other: dict[str, bytes], wide: dict[str, list[int]]) -> np.ndarray:
        if len(own) == 1 and not wide:
            lead, chunks, ended = own[0]
            if not chunks:
                return np.zeros(int(lead), np.int8)
            body = b"\0".join([cache[c] for c in chunks] if not other else [other[c] if c in other else cache[c] for c in chunks])
            return np.frombuffer(b"\0" * lead + body + b"\0" * ended, np.int8)
        get = lambda c: wide[c] if c in wide else np.frombuffer(other[c] if c in other else cache[c], np.int8)
        pieces: list[np.ndarray | list[int]] = []
        for i, (lead, chunks, ended) in enumerate(own):
            if i % 2:
                found = np.cumsum(get(self.joined(own, i)))
                n = len(chunks[0])
                before = int(found[-n - 1]) if len(found) > n else 0
                inner = found[-n:] - before
                inner[-1] = 1
                pieces.append(np.diff(inner, prepend=0))
            else:
                pieces += [[0]] * lead + [x for k, c in enumerate(chunks) for x in ([[0]] * (k > 0) + [get(c)])] + [[0]] * (ended and bool(chunks))
        out = np.concatenate([np.zeros(0, np.int64), *(np.asarray(p, np.int64) for p in pieces)])
        return out.astype(np.int8) if not len(out) or (out.min() >= -128 and out.max() <= 127) else out.astype(np.int32)

    def count(self, text: str) -> int:
        return int(self.batch_steps([text])[0].sum(dtype=np.int64))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts at the prefixes of 0 to n code points of the normalised text."""
        return np.r_[0, np.cumsum(self.batch_steps([text])[0], dtype=np.int64)]


def pack_steps(steps: np.ndarray) -> bytes:
    return steps.dtype.itemsize.to_bytes(1, "little") + zstandard.compress(steps.tobytes(), 1)


def counts_of(packed: bytes) -> np.ndarray:
    """Counts at the prefixes of 0 to n code points from a value of the column prefix_steps."""
    return np.r_[0, np.cumsum(np.frombuffer(zstandard.decompress(packed[1:]), "<i1" if packed[0] == 1 else "<i4"), dtype=np.int64)]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix, in code points of the normalised text, that has `budget` tokens at most."""
    return int(np.flatnonzero(counts <= budget)[-1])


_coders: dict[str, WordBpe] = {}


def coder(path: str | None = None, rare: str | None = None) -> WordBpe:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _coders:
        _coders[path] = WordBpe(path, rare)
    return _coders[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, cut (where the longest prefix of `limit` tokens ends, in code points of the normalised
    text; null if the text is within the limit) and prefix_steps, the packed counts at all prefixes (see counts_of)."""
    import public_tokenizers

    rare = probed(unlike, path or public_tokenizers.path("word_bpe_49k.json"), docs.sparkSession)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut bigint, prefix_steps binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, rare)
        for batch in slices(batches, "text", BATCH_TEXT):
            made = bpe.batch_steps(texts(batch))
            counts = [int(x.sum(dtype=np.int64)) for x in made]
            cuts = [longest_within(np.r_[0, np.cumsum(x, dtype=np.int64)], limit) if n > limit else None for x, n in zip(made, counts, strict=True)]
            sizes = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            columns = [batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(cuts, pa.int64()), pa.array(map(pack_steps, made), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit", "cut", "prefix_steps"])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
