"""Exact top-k, chat linking and the lattice model (ops 6, 5, 7) against brute force; the pipeline."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import op5_chat, op6_topk, op7_lattice
from lodestone.llm.registry import ORACLE_SQL, QUERIES

from ..compare import connect, of_duck, of_spark
from .conftest import rows_of


def test_op6_oracle(spark, small):
    assert of_spark(QUERIES["op6_topk"](spark, small)) == of_duck(connect(small), ORACLE_SQL["op6_topk"])


def slow_top(rows, least=lambda v: v):
    good = [(i, [math.floor(Fraction(float(np.float32(x))) * 1024) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked, want = {}, {}
    for (i, v), (_, raw) in zip(good, [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)], strict=True):
        if i % 100 == 0 and (i not in asked or raw < asked[i][0]):
            asked[i] = raw, v
    for q, (_, v) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored[:10])}
    return want


def top_rows(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], f"vec_id bigint, embedding array<{kind}>, score int, block string").repartition(3)
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in op6_topk.top_k(df, df.where(F.col("vec_id") % 100 == 0)).collect()}


def test_op6_odd(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(40)]  # ties
    rows += [(800, None), (900, [None] * 8), (901, [float("nan")] * 8), (902, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (1000, [0.5] * 3), (1001, [0.25] * 3), (1100, []), (1200, [1e5] + [0.0] * 7)]
    rows += [(100, [None] * 8), (200, [float("nan")] * 8), (300, None), (400, [-0.1] * 8), (1300, [3e6, -2e6, *[0.5] * 6]), (1301, [2e6] * 8)]  # ids that repeat with other vectors; large ones
    assert top_rows(spark, rows) == slow_top(rows)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert op6_topk.top_k(empty, empty).count() == 0


def test_op6_large_scores(spark):
    """Exact where the score fits a long, an error where it doesn't."""
    assert top_rows(spark, [(0, [1.0]), (1, [4e9]), (2, [2e9]), (3, [-4e9])]) == {(0, 1): (1, 4000000000 * 1024**2), (0, 2): (2, 2000000000 * 1024**2), (0, 3): (3, -4000000000 * 1024**2)}
    big = [(0, [1.0, 2.0**-10]), (1, [2.0**42, -(2.0**52)]), (2, [2.0**41, 2.0**50]), (3, [0.5, 2.0**42])]
    assert top_rows(spark, big) == slow_top(big)
    assert top_rows(spark, [(0, [1.0]), *((i, [float(i)]) for i in range(1, 11)), (50, [-1e30])])[0, 10] == (1, 1024**2)  # what doesn't fit is no result
    with pytest.raises(Exception, match="does not fit a long"):
        top_rows(spark, [(0, [1.0]), (1, [1e30])])
    with pytest.raises(Exception, match="does not fit a long"):
        top_rows(spark, [(0, [1e300]), (1, [1e300]), (2, [-1.0])], "double")


def test_bit_slices():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (200, 6))
    bitmaps, least, dropped = op6_topk.slices_of(x)
    query = rng.integers(-50, 50, 6)
    flipped = bitmaps ^ np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None, None]
    weighted = {}
    for j in range(6):
        for b in range(6):
            if abs(int(query[j])) >> b & 1:
                for k in range(bitmaps.shape[1]):
                    weighted.setdefault(b + k, []).append(flipped[j : j + 1, k])
    total = op6_topk.add_slices(weighted, bitmaps.shape[2])
    sums = sum(np.unpackbits(t.view(np.uint8), bitorder="little").astype(int) << k for k, t in enumerate(total))[:200]
    high, top = (x >> dropped) - least, (1 << bitmaps.shape[1]) - 1
    assert (sums == (np.abs(query) * np.where(query < 0, top - high, high)).sum(axis=1)).all()


CHAT = [
    (1, 0, "user", "Hello there.\nWhich tea is best?\n\nThanks"),
    (1, 1, "assistant", "Green tea."),
    (1, 2, "user", "On Monday, Bob wrote:\n> Which  TEA is best?\nI meant black tea."),
    (1, 3, "assistant", ">> Which tea is best?\n> I meant black tea.\nAssam then."),
    (1, 4, "user", "> never said by anyone\nhm"),
    (1, 5, "user", "> Green tea.\n> > Which tea is best?\nok"),
    (2, 0, "user", "> Green tea.\nas the other one said"),
    (2, 1, None, None),
    (None, 1, "user", "> Green tea."),
    (3, None, "user", "> Green tea."),
    (4, 7, "user", ""),
    (4, 7, "user", ""),
    (5, 0, "user", "one line\ntwo line\nthree line\n\nnext part\n\nlast part"),
    (5, 1, "user", "> two line\n> three line\nlines of a paragraph"),
    (5, 2, "user", "> next part\n>\n> last part\ntwo of three paragraphs"),
    (5, 3, "user", "> three line\n> \n> next part\nacross paragraphs"),
    (5, 4, "user", "> one line two\n> line three line\nwrapped anew"),
    (5, 5, "user", "> two line\n> one line\nin another order"),
    (5, 6, "user", "> wrapped anew\n> On Monday Bob wrote:\n> > one line\n> > two line\nnested, with its attribution"),
    (5, 7, "user", "x" * 250 + " wrote:\n> wrapped anew\nlong attribution"),
]


def test_op5(spark):
    got = {(r.conv_id, r.turn): r for r in op5_chat.conversations(spark.createDataFrame([(*c, 1, 2) for c in CHAT], "conv_id bigint, turn bigint, role string, text string, parent_turn int, hash int")).collect()}
    parent = lambda c, t: (got[c, t].parent_conv, got[c, t].parent_turn, got[c, t].root_turn, got[c, t].depth)
    assert parent(1, 0) == (None, None, 0, 0) and parent(1, 2) == (1, 0, 0, 1) and parent(1, 3) == (1, 0, 0, 1)
    assert parent(1, 4) == (None, None, 4, 0) and parent(1, 5) == (1, 1, 1, 1)
    assert parent(2, 0) == (1, 1, 0, 0)  # a passage of another conversation
    assert got[1, 2].text == "I meant black tea." and got[1, 3].text == "Assam then." and got[1, 3].max_level == 2 and got[1, 3].n_quotes == 2
    assert got[2, 1].text == "" and got[None, 1].root_turn == 1 and got[3, None].root_turn is None
    assert [parent(5, t)[1] for t in range(1, 8)] == [0, 0, 0, 0, None, 4, 4]
    assert got[5, 7].text == "long attribution" and got[5, 6].text == "nested, with its attribution"
    assert len(got) == len(CHAT) - 1


def slow_links(rows):
    """For each message the turn that its first linking passage is held by, by comparing lines."""
    parsed, out = [], {}
    for t, text in rows:
        _, own, _, quotes = op5_chat.parse(text)
        out[t] = None
        for _, lines in quotes:
            for u, lines_there in reversed(parsed):
                kept = [x for x in lines_there if x]
                if any(kept[i : i + len(lines)] == lines for i in range(len(kept) - len(lines) + 1)):
                    out[t] = u
                    break
            if out[t] is not None:
                break
        parsed.append((t, own))
    return out


def quoted_corpus(seed, n):
    """Messages of several paragraphs; replies quote runs of lines of an earlier one, some with quotes inside or an attribution."""
    rng, rows, said, truth = random.Random(seed), [], [], {}
    for t in range(n):
        own = []
        for _ in range(rng.randint(1, 3)):
            own += [f"line {rng.randint(0, 10**6)} of {t} is  Said" for _ in range(rng.randint(1, 4))] + [""]
        head = []
        if t and rng.random() < 0.8:
            p = rng.randrange(t)
            lines = said[p]
            a = rng.randrange(len(lines))
            b = rng.randint(a + 1, len(lines))
            quote = [x for x in lines[a:b]]
            if any(quote):
                truth[t] = p
                if rng.random() < 0.5:
                    head.append(f"On day {t} someone wrote:")
                head += [f"> {x}".upper() if rng.random() < 0.2 else f"> {x}" for x in quote]
                if p in truth and rng.random() < 0.4:
                    head += [f"> Then x{p} wrote:"] * (rng.random() < 0.5) + [f"> > {x}" for x in said[truth[p]] if x]
        said.append(own)
        rows.append((t, "\n".join([*head, *own])))
    return rows, truth


@pytest.mark.parametrize("seed", [1, 2])
def test_op5_generated(spark, seed):
    """Links against line comparison, recall against what was quoted, and the order against a walk of the tree."""
    rows, truth = quoted_corpus(seed, 250)
    got = op5_chat.conversations(spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id bigint, turn bigint, role string, text string").repartition(4)).collect()
    links = {r.turn: r.parent_turn for r in got}
    assert links == slow_links(rows)
    assert sum(links[t] == p for t, p in truth.items()) >= 0.99 * len(truth)
    replies = {}
    for t, p in sorted(links.items()):
        replies.setdefault(p, []).append(t)

    def walk(t):
        return [t, *(x for r in replies.get(t, []) for x in walk(r))]

    assert [r.turn for r in got] == [x for root in replies[None] for x in walk(root)]
    assert all(r.place == walk(r.root_turn).index(r.turn) for r in got)


def test_op5_long_texts(spark):
    """Very long messages, and a quote of thousands of lines."""
    lines = [f"line {i}" for i in range(20_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join(f"> {x}" for x in lines[5000:9000]) + "\nyes"), (1, 2, "user", "z" * 2_000_000), (1, 3, "user", "> " + "z" * 2_000_000)]
    got = {r.turn: (r.parent_turn, r.n_quotes) for r in op5_chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (None, 0), 3: (2, 1)}


def test_op5_long_threads(spark):
    """A chain of quotes across many blocks of turns, against a walk."""
    rng = random.Random(7)
    said, rows, root, depth = [], [], {}, {}
    for t in range(1500):
        text = f"unique words number {t}"
        if t and rng.random() < 0.6:
            p = rng.randrange(max(0, t - 700), t)
            rows.append((9, t, "user", f"> {said[p]}\n{text}"))
            root[t], depth[t] = root[p], depth[p] + 1
        else:
            rows.append((9, t, "user", text))
            root[t], depth[t] = t, 0
        said.append(text)
    got = op5_chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r.turn: (r.root_turn, r.depth) for r in got} == {t: (root[t], depth[t]) for t in root}
    assert [r.root_turn for r in got] == sorted(root[t] for t in root)


def test_op5_table(spark, small):
    conversations = spark.read.parquet(f"{small}/conversations.parquet")
    assert op5_chat.conversations(conversations).count() == conversations.count()
    assert op5_chat.conversations(conversations.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_op7_base(request, which):
    docs = request.getfixturevalue(which)
    rows = [(i, op7_lattice.words_of(t or ""), zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t in rows_of(docs)]
    counts = Counter()
    for _, words, held in rows:
        if not held:
            counts.update([*words, None])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter((i, held, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in [*w, None]), 4)) for i, w, held in rows)
    got = op7_lattice.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.lattice_score) and r.lattice_score < 0 for r in got)


def slow_marginal(s, p):
    """Sum over all spellings, one by one."""
    return 1.0 if not s else sum(p[s[:k]] * slow_marginal(s[k:], p) for k in range(1, len(s) + 1) if s[:k] in p)


def test_forward():
    rng = random.Random(1)
    for _ in range(100):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        p = {x: rng.random() for x in ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aab", "bbb"]}
        assert math.exp(op7_lattice.forward(word, {k: math.log(v) for k, v in p.items()}, [-9.0] * 256, 3)) == pytest.approx(slow_marginal("▁" + word, p))
    assert op7_lattice.forward("é", {"▁": 0.0}, [-1.0] * 256, 1) == pytest.approx(-2.0)  # two bytes


def test_op7_held_out(spark):
    """On documents held out the lattice tells real order of letters from shuffled ones, and knows known words well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    shuffled = [(100_000 + i, " ".join("".join(rng.sample(w, len(w))) for w in r.text.split())) for i, r in enumerate(docs.where("doc_id % 20 = 0").select("text").collect())]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(shuffled, "doc_id bigint, text string"))
    got = op7_lattice.score(both, held_out=(F.col("doc_id") >= 100_000) | (F.col("doc_id") % 20 == 0)).collect()
    real = [r.score / r.n_tokens for r in got if r.held_out and r.doc_id < 100_000]
    fake = [r.score / r.n_tokens for r in got if r.doc_id >= 100_000]
    assert np.mean(real) > np.mean(fake) + 2


def test_op7_score(spark):
    """The whole score against a sum over all segmentations, one by one, with weights worked out piece by piece."""
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, t) for i, t in enumerate(["The cat sat", "a cat", "dogs été", "", None, "sat sat 日 \U0001f600", "cats do", "THE", "on it", "dog", "a b", "to cat"])]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    assert 0 < len(train) < len(rows)
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    uses = Counter(p for i in train for w in words(rows[i][1]) for p in lib.encode(w))
    n = lib.get_piece_size()
    rank = {i: float(n) if lib.is_byte(i) else max(0.0, -lib.get_score(i)) for i in range(n) if lib.is_byte(i) or not (lib.is_control(i) or lib.is_unknown(i))}
    zipf = {i: 1 / (r + 10) for i, r in rank.items()}
    scale = 1000 / sum(zipf.values())
    group = {i: (lib.is_byte(i), lib.id_to_piece(i).startswith("▁"), min(63, int(4 * math.log2(r + 1)))) for i, r in rank.items()}
    used, size = Counter(), Counter()
    for i, g in group.items():
        used[g] += uses[i] + scale * zipf[i]
        size[g] += zipf[i]
    total = sum(uses.values()) + 1000 + len(train) + 1
    weight = {i: used[g] * zipf[i] / size[g] / total for i, g in group.items()}
    assert sum(weight.values()) + (len(train) + 1) / total == pytest.approx(1)
    p = {lib.id_to_piece(i): w for i, w in weight.items() if not lib.is_byte(i)}
    for w in {w for _, t in rows for w in words(t)}:
        for c in w:
            if c not in p:
                p[c] = math.prod(weight[lib.piece_to_id(f"<0x{b:02X}>")] for b in c.encode())
    want = {i: math.log10((len(train) + 1) / total) + sum(math.log10(slow_marginal("▁" + w, p)) for w in words(t)) for i, t in rows}
    got = op7_lattice.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: r.lattice_score for r in got} == pytest.approx(want)
    known = Counter(w for i in train for w in words(rows[i][1]))
    tokens = sum(known.values()) + len(train)
    u = min(0.5, (sum(c == 1 for c in known.values()) + 1) / (tokens + 2))
    start = sum(w for i, w in weight.items() if group[i][1])
    spelt = lambda w: slow_marginal("▁" + w, p) * (start + (len(train) + 1) / total) / start
    want = {i: math.log10((1 - u) * len(train) / tokens) + sum(math.log10((1 - u) * known[w] / tokens + u * spelt(w)) for w in words(t)) for i, t in rows}
    assert {r.doc_id: r.score for r in got} == pytest.approx(want)


def test_op7_longest_piece():
    pieces = op7_lattice.vocabulary()
    assert pieces.longest == max(map(len, pieces.id_of))


def test_op7_edges(no_documents, odd_documents):
    assert op7_lattice.score(no_documents).count() == 0
    none = op7_lattice.score(odd_documents, held_out=F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_pipeline(spark, small):
    from lodestone.llm.common import materialise, table

    docs = table(spark, small, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, small), "test")
        assert docs.columns == columns and 0 < docs.count() <= before, name
        assert docs.where("n_chars <> length(text)").count() == 0
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, small)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(run.select(key).collect()) == Counter(packed.select(key).collect())


def test_pipeline_odd_columns(spark, odd_documents, small):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd_documents.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_pipeline_empty(spark, no_documents, small):
    """No documents: every stage gives an empty table with its columns."""
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == no_documents.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 0


def test_pipeline_brute_force(spark, tmp_path, small):
    """Stages on planted cases: short and rejected rows, copies, a shared passage, personal data; against hand-made results."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    passage, a, b = fresh(60), fresh(120), fresh(90)
    rows = [
        (1, " ".join(a)), (2, " ".join(a)), (3, "too short"), (4, None), (5, " ".join([*fresh(70), *passage])), (6, " ".join([*b, *passage, *fresh(60)])),
        (7, " ".join([*fresh(60), "mail", "me@site.org", *fresh(9)])), (8, " ".join(["same three words"] * 40)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    none.write.parquet(str(tmp_path / "labels.parquet"))  # no labels: the base rules alone decide
    texts = dict(rows)
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        seen.append({r.doc_id: r.text for r in now.collect()})
    assert seen[0] == {i: texts[i] for i in (1, 2, 5, 6, 7)}
    assert seen[1] == {i: texts[i] for i in (1, 5, 6, 7)}
    cut = " ".join(w for w in texts[6].split() if w not in set(passage))
    assert seen[2] == {**seen[1], 6: cut}
    assert seen[3] == {**seen[2], 7: texts[7].replace("me@site.org", "[EMAIL]")}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.length for r in packed} == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in seen[3].items()}
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 2048)
