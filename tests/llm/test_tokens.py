"""Packing, token counts and BPE (ops 1, 8, 9) against the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import op1_packing, op8_counts, op9_bpe

from .conftest import rows_of

ODD = ["", "a" * 3000, "<|endoftext|>", "x<|endoftext|> y<|startoftext|>z", "  a  b \t\n\n c ", "it's we'll I'D '''re !'s", "日本語テキスト", "é é", "\x1c\x1d a\x85b", "😀👍🏽", "\x00\x01", "ab" * 900, "٣٤٥ x²½", "ΑΣ İI", " " * 9000 + "z"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_odd():
    lib, own = library("byte_bpe_50k.json"), op9_bpe.coder()
    for text, packed in zip(ODD, own.encode_batch(ODD), strict=True):
        want = lib.encode(text, add_special_tokens=False)
        assert np.frombuffer(packed, "<u4").tolist() == want.ids
        assert own.decode(packed).decode() == lib.decode(want.ids, skip_special_tokens=False)


def test_pair_index_small_alphabet():
    """Words over few letters merge in every way; the library is the reference."""
    rng, lib, own = random.Random(2), library("byte_bpe_50k.json"), op9_bpe.coder()
    words = ["".join(rng.choice("aetn") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(words)] == [e.ids for e in lib.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_op9(request, which):
    docs, lib = request.getfixturevalue(which), library("byte_bpe_50k.json")
    want = Counter()
    for i, t in rows_of(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in op9_bpe.encode_decode(docs).collect()) == want


def test_op9_round_trip(documents):
    got = op9_bpe.encode_decode(documents, ids=True).join(documents, "doc_id")
    assert got.where("decoded <> text").count() == 0


def test_prefix_counts():
    lib, own = library("word_bpe_49k.json"), op8_counts.coder()
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for text in [t if "<|" in t else own.normalise(t)[:250] for t in ODD] + ["hello, world! it's 2024; don't.", "we'll'll ''s 're're x!'re", "end <|endoftext|>", "a!!<|endoftext|><|endoftext|>b 'r<|startoftext|>"]:
        counts = own.prefix_counts(text)
        assert counts.tolist() == [n(text[:i]) for i in range(len(text) + 1)], text
        for budget in (0, 1, 5):
            cut = op8_counts.longest_within(counts, budget)
            assert n(text[:cut]) <= budget and all(n(text[:i]) > budget for i in range(cut + 1, len(text) + 1))


def test_steps_beyond_a_byte():
    """Steps that need more than a byte are stored wider."""
    steps = np.array([300, -5, 0], np.int32)
    assert op8_counts.counts_of(op8_counts.pack_steps(steps)).tolist() == [0, 300, 295, 295]
    parts = [(True, ["x", "y"], False), (False, ["<|s|>"], False), (False, [], False)]
    made = op8_counts.coder().assemble(parts, {"x": b"\x01"}, {}, {"y": [400], "y<|s|>": [400, 1, 0, 0, 0, 1]})
    assert made.dtype == np.int32 and made.tolist() == [0, 1, 0, 400, 1, 0, 0, 0, 0]


def all_points():
    return [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("kind", ["word", "byte", "quick"])
def test_every_code_point(kind):
    """Each code point beside a letter, a digit and itself, and in random company, as the library has it."""
    lib = library("word_bpe_49k.json" if kind == "word" else "byte_bpe_50k.json")
    rng, points = random.Random(11), all_points()
    rows = ["\n".join(f"a{chr(c)}{chr(c)}b {chr(c)}1" for c in points[k : k + 512]) for k in range(0, len(points), 512)]
    low = [c for c in points if c < 0x3000]
    rows += ["".join(chr(rng.choice(low if rng.random() < 0.7 else points)) for _ in range(rng.randint(1, 12))) for _ in range(500 if kind == "quick" else 6000)]
    want = [e.ids for e in lib.encode_batch(rows, add_special_tokens=False)]
    if kind == "word":
        assert [int(x.sum()) for x in op8_counts.coder().batch_steps(rows)] == [len(w) for w in want]
    elif kind == "byte":
        assert [np.frombuffer(x, "<u4").tolist() for x in op9_bpe.coder().encode_batch(rows)] == want
    else:
        search = re.compile(op1_packing.other_way()).search
        assert [op1_packing.token_ids(t, search).tolist() for t in rows] == [[*w, 0] for w in want]


def test_long_white_space():
    """On both sides of where the coder changes."""
    lib, search = library("byte_bpe_50k.json"), re.compile(op1_packing.other_way()).search
    for n in (1999, 2000, 2001, 3999, 4000, 4001, 8001):
        for space in (" ", "\n", "\u00a0"):
            for text in (space * n, f"a{space * n}b", f"a b{space * n}"):
                assert op1_packing.token_ids(text, search).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_op8(request, which):
    docs, lib = request.getfixturevalue(which), library("word_bpe_49k.json")
    want = Counter()
    for i, t in rows_of(docs):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    got = op8_counts.token_counts(docs).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    for r in got:
        counts = op8_counts.counts_of(r.prefix_steps)
        assert counts[-1] == r.n_tokens and r.cut == (op8_counts.longest_within(counts, 2048) if r.over_limit else None)


def check_packing(docs, got, capacity):
    lib = library("byte_bpe_50k.json")
    want = Counter()
    for i, t in rows_of(docs):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        for k, start in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[start : start + (capacity if k else first)]
            want[i, k, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity and sum(n > capacity // 3 for _, n in b) <= 2
    return len(bins), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize(("which", "capacity"), [("documents", 2048), ("odd_documents", 2048), ("odd_documents", 64)])
def test_op1(request, which, capacity):
    docs = request.getfixturevalue(which)
    bins, least = check_packing(docs, op1_packing.pack(docs, capacity).collect(), capacity)
    assert bins <= least * 1.02 + 1


def test_plan_against_best_fit():
    """Never worse than best-fit decreasing over single items by more than a bin in a hundred."""
    rng = random.Random(4)
    for capacity in (10, 64, 2048):
        for _ in range(15):
            lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.choice([1, 7, 400]))]
            gaps = []
            for n in sorted(lengths, reverse=True):
                fit = [g for g in gaps if g >= n]
                if fit:
                    gaps.remove(min(fit))
                    gaps.append(min(fit) - n)
                else:
                    gaps.append(capacity - n)
            runs = op1_packing.plan(dict(Counter(lengths)), capacity)
            used = {}
            for a, n in Counter(lengths).items():
                for k in range(n):
                    _, rank, first, per, _ = max((tuple(r) for r in runs.tolist() if r[0] == a and r[1] <= k), key=lambda r: r[1])
                    used[first + (k - rank) // per] = used.get(first + (k - rank) // per, 0) + a
            assert max(used.values()) <= capacity and sum(used.values()) == sum(lengths)
            assert len(used) <= len(gaps) * 1.01 + 1


def test_empty(no_documents):
    assert op1_packing.pack(no_documents).collect() == []
    assert op8_counts.token_counts(no_documents).collect() == []
    assert op9_bpe.encode_decode(no_documents).collect() == []
