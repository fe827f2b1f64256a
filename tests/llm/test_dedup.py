"""SimHash near-duplicates and repeated passages (ops 3, 4) against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lodestone.llm import op3_simhash, op4_substring
from lodestone.llm.graph import components

from .conftest import rows_of, sentence


def slow_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_print(t or "") for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return Counter((i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints, strict=True))


@pytest.mark.parametrize("which", ["documents", "odd_documents", "no_documents"])
def test_op3(request, which):
    docs = request.getfixturevalue(which)
    assert Counter(tuple(r) for r in op3_simhash.near_duplicates(docs).collect()) == slow_components(rows_of(docs))


def test_links_complete(spark):
    """Clusters of fingerprints at any two bits: every linked pair meets at an anchor."""
    rng = random.Random(8)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(12):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.u, r.v) for r in op3_simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}


def written(df, folder):
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def final_plan(df):
    """The plan that ran, once df has been collected."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_not_broadcast(spark, tmp_path):
    """What comes from a small file of fingerprints is some 33 times as many rows, which must not meet on the driver."""
    nodes = written(spark.range(300).selectExpr("xxhash64(id) as fp").union(spark.range(4).selectExpr("7 * id as fp")), tmp_path / "nodes")
    links = op3_simhash.links(nodes)
    assert {(r.u, r.v) for r in links.collect()} == {(a, b) for a in (0, 7, 14, 21) for b in (0, 7, 14, 21) if a < b and (a ^ b).bit_count() <= 2}
    assert "Broadcast" not in final_plan(links)


def test_pairs_are_not_broadcast(spark, tmp_path):
    """Pairs and differences are columns of few values, so their files are far smaller than they are."""
    words = [np.array([*range(100), 1000 + i // 2], "<u4") for i in range(6)]
    sets = written(spark.createDataFrame([(i, bytearray(w.tobytes())) for i, w in enumerate(words)], "key bigint, words binary"), tmp_path / "sets")
    pairs = written(spark.createDataFrame([(i, 0, 0, i) for i in range(1, 6)], "key bigint, other bigint, u bigint, v bigint"), tmp_path / "pairs")
    met = op3_simhash.verified(pairs, sets)
    assert {(r.u, r.v) for r in met.collect()} == {(0, i) for i in range(1, 6)}
    joins = re.findall(r"(\w+Join) \[key#", final_plan(met))
    assert joins and set(joins) == {"SortMergeJoin"}

    apart = [np.array([*range(60), *range(1000 * k, 1000 * k + 40)], "<u4") for k in (1, 2, 2, 3)]
    sets = written(spark.createDataFrame([(i, bytearray(w.tobytes())) for i, w in enumerate(apart)], "key bigint, words binary"), tmp_path / "apart")
    members = spark.createDataFrame([(0, i, i) for i in range(1, 4)], "pivot bigint, key bigint, part bigint")
    telling = op3_simhash.telling_pairs(members, sets)
    assert {frozenset((r.key, r.other)) for r in telling.collect()} == {frozenset((1, 2))}
    assert "Broadcast" not in final_plan(telling)


def test_components(spark):
    chain = [(i, i + 1) for i in range(70)] + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 40)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(71), 0), **dict.fromkeys(range(100, 103), 100), **dict.fromkeys(range(300, 340), 300)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_one_of_each(odd_documents, no_documents):
    kept = op3_simhash.one_of_each(odd_documents)
    rows = rows_of(kept)
    ids = [i for i, _ in rows if i is not None]
    assert max(Counter(i for i in ids if i != 3).values()) == 1
    assert sum(i is None for i, _ in rows) == 2 and kept.columns == odd_documents.columns
    assert sorted(t for i, t in rows if i == 3) == sorted({t for i, t in rows_of(odd_documents) if i == 3})  # unlike texts under one id
    assert 7 in ids and 66 not in ids and 67 not in ids  # copies, one of them in capitals
    assert op3_simhash.one_of_each(no_documents).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_one_of_each_repeated_ids(spark, seed):
    """Every text that has no copy stays, whatever rows share its id, and one of each group of copies."""
    rng = random.Random(seed)
    a, b = sentence(rng, 90), sentence(rng, 80)
    alone = [sentence(rng, rng.randint(30, 90)) for _ in range(6)]
    rows = [(1, a), (3, a), (3, alone[0]), (3, b), (2, b), (2, alone[1]), (1, alone[2]), (7, alone[3]), (7, alone[4]), (7, a), (9, alone[5]), (9, alone[5])]
    rng.shuffle(rows)
    kept = [tuple(r) for r in op3_simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    assert sorted(kept) == sorted([(1, a), (2, b), *{(i, t) for i, t in rows if t in alone}])


def test_one_of_each_wide(spark):
    """Five-word Jaccard of 0.8 links in the stage, whatever the fingerprints' bits, and nothing below does."""
    rng = random.Random(12)
    rows, sets = [], []
    for _ in range(40):
        words = sentence(rng, 300).split()
        for _ in range(2):
            copy = list(words)
            for k in rng.sample(range(300), rng.randint(1, 5)):
                copy[k] = f"z{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(copy)))
            sets.append({tuple(copy[i : i + 5]) for i in range(296)})
    near = {(i, i + 1) for i in range(0, 80, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    bits = [(slow_print(rows[i][1]) ^ slow_print(rows[j][1])).bit_count() for i, j in near]
    assert sum(b > 2 for b in bits) > 3 and len(near) < 40
    gone = {j for i, j in near} | {i + 1 for i in range(0, 80, 2) if (slow_print(rows[i][1]) ^ slow_print(rows[i + 1][1])).bit_count() <= 2}
    kept = op3_simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert {r.doc_id for r in kept.collect()} == set(range(80)) - gone


def slow_kept(rows):
    """The least id of each component of both link rules, by comparing all pairs."""
    prints = [slow_print(t) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[min(k for k in range(len(rows)) if find(k) == find(i))][0] for i in range(len(rows))}


@pytest.mark.parametrize(("rounds", "plain"), [(0, False), (2, False), (1, True)])
def test_one_of_each_large_group(spark, monkeypatch, rounds, plain):
    """Many near copies of one text, with few edits and many, also shortened and with a common addition: the components are those
    of all pairs, whatever the rounds before the comparison of the rest. Of copies with edits of their own few pairs are compared."""
    monkeypatch.setattr(op3_simhash, "ROUNDS", rounds)
    rng, rows = random.Random(31), []
    for n in (160, 90):
        base = [f"b{n}x{i}" for i in range(n)]
        for _ in range(110):
            copy = list(base)
            for k in rng.sample(range(n), rng.randint(0, n // 12)):
                copy[k] = f"z{rng.randint(0, 30 if rng.random() < 0.3 else 9999)}"
            kind = 1.0 if plain else rng.random()
            if kind < 0.15:
                copy = copy[: int(n * 0.7)]
            elif kind < 0.3:
                copy += [f"more{n}x{i}" for i in range(n // 3)]
            rows.append((len(rows), " ".join(copy)))
    met = []
    compare = op3_simhash.verified
    monkeypatch.setattr(op3_simhash, "verified", lambda pairs, sets: met.append(pairs.count()) or compare(pairs, sets))
    kept = {r.doc_id for r in op3_simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert kept == slow_kept(rows) and 10 < len(kept) < 200
    if plain:
        assert sum(met) < 8 * len(rows), met


def slow_edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[-1] + 1))
        before = now
    return before[-1]


def test_edits():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        most = rng.randint(0, 14)
        assert op4_substring.edits(a, b, most) == min(slow_edits(a, b), most + 1)


def test_chain_is_best():
    """Each segment's best chain scores as in a quadratic recursion; chains are in order and hold each segment once."""
    rng, o = random.Random(2), op4_substring
    for _ in range(300):
        found = set()
        for _ in range(rng.randint(1, 25)):
            a, b, n = rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 14)
            found.add((a, a + n, b, b + n))
        found = sorted(found)
        want = []
        for a, e, b, _ in found:
            fits = [want[j] - o.GAP_COST / 2 * (a - x[1] + b - x[3]) for j, x in enumerate(found[: len(want)]) if x[1] - o.OVERLAP <= a and x[3] - o.OVERLAP <= b]
            want.append(e - a + max([0.0, *fits]))
        assert o.best_chains(found)[0] == pytest.approx(want)
        chains = o.chain(found)
        assert sorted(x for c in chains for x in c) == found
        for c in chains:
            for x, y in zip(c, c[1:]):
                assert x[1] - o.OVERLAP <= y[0] <= x[1] + o.MAX_GAP and x[3] - o.OVERLAP <= y[2] <= x[3] + o.MAX_GAP


def test_extend_and_align():
    assert op4_substring.extend([1, 2, 3, 4], [1, 2, 3, 4]) == (4, 4, 0)
    more = list(range(10, 16))
    assert op4_substring.extend([1, 2, 9, *more], [1, 2, 8, *more]) == (9, 9, 1)
    assert op4_substring.extend([1, 2, *more], [1, 2, 7, *more]) == (8, 9, 1) and op4_substring.extend([1, 2, 9, 3], [1, 2, 8, 3]) == (2, 2, 0)
    assert op4_substring.extend([7] * 50, [8] * 50) == (0, 0, 0) and op4_substring.extend([], [1]) == (0, 0, 0)
    rng = random.Random(4)
    for _ in range(200):  # what is passed can be aligned at that cost
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        b = [x if rng.random() < 0.85 else rng.randint(0, 5) for x in a]
        x, y, d = op4_substring.extend(a, b)
        assert slow_edits(a[:x], b[:y]) <= d


def planted(rng, edits):
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages, rows, holders = [text(55) for _ in range(5)], [], {}
    for i in range(160):
        own = text(rng.randint(50, 250))
        if i % 4 == 0:
            k = rng.randrange(5)
            copy = list(passages[k])
            for _ in range(edits if i % 8 == 0 else 0):
                copy[rng.randrange(55)] = f"z{rng.randint(0, 9999)}"
            at = rng.randint(0, len(own))
            own = own[:at] + copy + own[at:]
            holders.setdefault(k, []).append((i, at))
        rows.append((i, " ".join(own)))
    return rows, holders


@pytest.mark.parametrize("edits", [0, 2])
def test_op4_planted(spark, edits):
    rows, holders = planted(random.Random(edits), edits)
    got = op4_substring.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    later = {i: at for own in holders.values() for i, at in own[1:]}
    assert {r.doc_id for r in got} == set(later)
    group = {i: k for k, own in holders.items() for i, _ in own}
    for r in got:
        assert r.ref_doc_id < r.doc_id and group[r.ref_doc_id] == group[r.doc_id] and r.similarity >= 0.8
        assert abs(r.passage_start - later[r.doc_id]) <= 15 and abs(r.passage_end - later[r.doc_id] - 55) <= 15
        if not edits:
            assert (r.passage_start, r.passage_end) == (later[r.doc_id], later[r.doc_id] + 55)


def test_op4_cut(spark):
    rows, holders = planted(random.Random(5), 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in op4_substring.without_passages(docs, op4_substring.passages(docs)).collect()}
    later = {i: at for own in holders.values() for i, at in own[1:]}
    for i, text in rows:
        words = text.split(" ")
        if i in later:
            words = words[: later[i]] + words[later[i] + 55 :]
        assert left[i].split() == words
    assert op4_substring.cut("a b\nc d", [(1, 3)]) == "a d" and op4_substring.cut("a b", [(0, 2)]) == ""


def test_op4_twice_in_a_document(spark):
    """A passage's second place in a document is found, whether or not an earlier document has it; a tandem repeat too."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    p, q, r, tandem = text(60), text(55), text(80), text(7)
    rows = [[*text(30), *p, *text(30)], [*text(20), *p, *text(40), *p, *text(9)], [*text(50), *q, *text(70), *q, *text(60), *q], [*r, *r], [*text(10), *tandem * 12, *text(10)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string").repartition(3)
    found = op4_substring.passages(docs)
    got = {(x.doc_id, x.passage_start, x.passage_end) for x in found.collect()}
    assert got == {(1, 20, 80), (1, 120, 180), (2, 175, 230), (2, 290, 345), (3, 80, 160), (4, 17, 94)}
    assert all(x.ref_doc_id < x.doc_id or x.ref_start < x.start for x in found.collect())
    left = {x.doc_id: x.text.split() for x in op4_substring.without_passages(docs, found).collect()}
    assert left[2] == rows[2][:175] + rows[2][230:290] and left[3] == r and left[0] == rows[0]


def test_op4_edges(odd_documents, no_documents):
    found = op4_substring.passages(odd_documents)
    assert {66, 67} <= {r.doc_id for r in found.collect()} or len(dict(rows_of(odd_documents))[7].split()) < 40
    kept = op4_substring.without_passages(odd_documents, found)
    assert kept.columns == odd_documents.columns and kept.where("doc_id is null").count() == 2
    assert op4_substring.passages(no_documents).count() == 0


def stretches(got):
    return {(r.doc_id, r.passage_start, r.passage_end) for r in got}


@pytest.mark.parametrize("edits", range(7))
def test_op4_recall(spark, edits):
    """Passages of 52 words with fresh random edits in each copy, among documents of other words; found means most of it is."""
    rng = random.Random(1000 + edits)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        passage = fresh(52)
        rows.append([*fresh(40), *passage, *fresh(40)])
        copy = list(passage)
        for k in sorted(rng.sample(range(52), edits), reverse=True):
            kind = rng.randrange(3)
            copy[k : k + 1] = [[f"z{rng.randint(0, 9999)}"], [], [copy[k], f"z{rng.randint(0, 9999)}"]][kind]
        want[len(rows)] = (30, 30 + len(copy))
        rows.append([*fresh(30), *copy, *fresh(50)])
    got = stretches(op4_substring.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string").repartition(5)).collect())
    assert {i for i, _, _ in got} <= set(want)
    hit = sum(any(d == i and min(b, e) - max(a, s) >= 0.75 * (b - a) for d, s, e in got) for i, (a, b) in want.items())
    assert hit >= 0.95 * len(want), hit


def slow_passages(rows):
    """Later documents' words that lie in a run of 40 or more words which an earlier document, or an earlier place, has word for word."""
    seen, out = {}, {}
    for i, words in rows:
        for k in range(len(words) - 39):
            run = tuple(words[k : k + 40])
            if run in seen:
                out.setdefault(i, set()).update(range(k, k + 40))
            else:
                seen[run] = i
    return out


def fragment_rows(seed):
    """Copies of passages with many documents between and before them that hold short pieces of these."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    passages, rows = [fresh(60) for _ in range(4)], []
    for i in range(120):
        own = fresh(30)
        for p in passages:
            n = rng.choice([7, 9, 12])
            at = rng.randint(0, 60 - n)
            own += [*p[at : at + n], *fresh(20)]
        if i % 15 == 7:
            own += [*passages[i % 4], *fresh(10)]
        rows.append((i, own))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op4_exact_copies_beside_fragments(spark, seed):
    """Every exact copy is found, whatever fragments stand before and between, and nothing else is."""
    rows = fragment_rows(seed)
    got = op4_substring.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(3)).collect()
    want = slow_passages(rows)
    covered = {}
    for i, a, b in stretches(got):
        covered.setdefault(i, set()).update(range(a, b))
    assert covered.keys() == want.keys() and all(want[i] <= covered[i] and len(covered[i] - want[i]) <= 12 for i in want)


def test_op4_layout(spark, monkeypatch, documents):
    """Equal results in any number of partitions and with batches of any size."""
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in fragment_rows(3)], "doc_id bigint, text string").union(documents.select("doc_id", "text").where("doc_id >= 120"))
    want = None
    for parts, words, shuffle in ((1, 1 << 20, 8), (4, 3000, 5), (16, 500, 3)):
        monkeypatch.setattr(op4_substring, "BATCH_WORDS", words)
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        got = Counter(tuple(r) for r in op4_substring.passages(rows.repartition(parts)).collect())
        assert want in (None, got) and got
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_op4_string_and_repeated_ids(spark):
    rng = random.Random(6)
    p = [f"p{k}" for k in range(55)]
    fresh = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    rows = [("a", [*fresh(30), *p]), ("b", fresh(80)), ("b", [*fresh(20), *p, *fresh(9)]), ("c", [*p, *fresh(30)])]
    docs = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows] + [("c", " ".join(rows[3][1]), "y")], "name string, body string, doc string")
    found = op4_substring.passages(docs, "name", "body")
    assert stretches(found.collect()) == {("b", 20, 75), ("c", 0, 55)}
    left = sorted((r.name, r.body.split(), r.doc) for r in op4_substring.without_passages(docs, found, "name", "body").collect())
    assert left == sorted([("a", rows[0][1], "x"), ("b", rows[1][1], "x"), ("b", [*rows[2][1][:20], *rows[2][1][75:]], "x"), ("c", rows[3][1][55:], "x"), ("c", rows[3][1][55:], "y")])


def test_minimizers_share_runs():
    """Any eight equal words in a row give a common seed."""
    rng = random.Random(3)
    for _ in range(50):
        run = sentence(rng, 8)
        hashes, sizes = op4_substring.word_hashes([f"{sentence(rng, 20)} {run} {sentence(rng, 20)}", f"{sentence(rng, 9)} {run} {sentence(rng, 3)}"])
        h, which, _ = op4_substring.minimizers(hashes, sizes)
        assert np.intersect1d(h[which == 0], h[which == 1]).size
