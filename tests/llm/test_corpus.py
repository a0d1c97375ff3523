"""Operators over the whole corpus: near duplicates, packing, token files, neighbours, the pipeline."""

import os
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import ann, jaccard, packing, queries, tokenfile, tokens
from candela.llm.components import components
from tests.llm.test_rows import ODD, docs, prose

DATA = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(1)
    for links in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)], []):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        parent = {x: x for e in links for x in e}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
        alone = {x for x in parent if all(a == b for a, b in links if x in (a, b))}
        assert got == {x: top(x) for x in parent if x not in alone}


def groups_by_hand(rows, words=5, percent=75):
    """Each row's set and the number of its component."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    return sets, group


def near_by_hand(rows, words=5, percent=75):
    (sets, group), least = groups_by_hand(rows, words, percent), {}
    for (doc, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), doc) if x is not None), default=None)
    return sorted((str(d), len(s), str(least[g])) for (d, _), s, g in zip(rows, sets, group, strict=True))


@pytest.fixture(scope="module")
def copies():
    """Near copies around the limit: one large group, small groups, shared passages, exact copies."""
    rng, texts = random.Random(2), [*ODD, "One two three", "one TWO three"]
    words = [f"w{i}" for i in range(300)]

    def edited(text, k):
        w = text.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words) + "x"
        return " ".join(w)

    base = " ".join(rng.choice(words) for _ in range(120))
    texts += [edited(base, rng.randint(0, 9)) for _ in range(110)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    for _ in range(12):
        b = " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))
        texts += [b, b, b.upper(), edited(b, 1), edited(b, 2)]
    rng.shuffle(texts)
    return texts


def test_jaccard_against_all_pairs(spark, copies, monkeypatch):
    ids = [i * 7 % 1009 for i in range(len(copies))]
    ids[3] = ids[4] = None
    ids[9] = ids[8]
    t = docs(spark, copies, ids=ids)
    want = near_by_hand(list(zip(ids, copies, strict=True)))
    for whole, pivots, few, every, held in ((24, 8, 200_000, 800_000, 500_000), (4, 2, 300, 2000, 900)):
        for k, v in (("WHOLE", whole), ("PIVOTS", pivots), ("FEW", few), ("ALL", every), ("HELD", held), ("FEW_SETS", 3 if whole == 4 else 2000), ("ALL_SETS", 7 if whole == 4 else 8000)):
            monkeypatch.setattr(jaccard, k, v)
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(t).collect())
        assert got == want
    kept = jaccard.keep_first(t)
    assert kept.columns == t.columns
    rows = list(zip(ids, copies, strict=True))
    sets, group = groups_by_hand(rows)
    of = {row: g for row, s, g in zip(rows, sets, group, strict=True) if s}
    stayed = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(of[r] for r in stayed if r in of) == sorted({g for g, s in zip(group, sets, strict=True) if s})
    assert sorted(map(repr, (r for r in stayed if r not in of))) == sorted(repr(r) for r, s in zip(rows, sets, strict=True) if not s)
    lowest = {g: min((d for (d, _), x in zip(rows, group, strict=True) if x == g and d is not None), default=None) for g in group}
    assert all(r[0] == lowest[of[r]] for r in stayed if r in of)
    assert jaccard.join(t.limit(0)).count() == 0 and jaccard.keep_first(t.limit(0)).count() == 0
    again = jaccard.keep_first(kept)
    assert again.count() == kept.count()


def test_jaccard_of_templates_and_copies(spark):
    """Very many short texts that share all but a word, and very many copies: no two sets of them meet, none is held twice."""
    templates = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g x"), F.col("id").cast("string")).alias("text"))
    copies = spark.range(100_000, 200_000).select(F.col("id").alias("doc_id"), F.lit("the same nine words stand here again and again").alias("text"))
    near = spark.createDataFrame([(300_000 + i, " ".join(f"v{j}" for j in range(40)) + f" z{i}") for i in range(60)], "doc_id long, text string")
    rows = jaccard.join(templates.unionByName(copies).unionByName(near))
    got = {(r["k"], r["c"]): r["n"] for r in rows.select(F.when(F.col("doc_id") < 100_000, "t").when(F.col("doc_id") < 300_000, "c").otherwise("n").alias("k"), F.when(F.col("component_id") == F.col("doc_id"), "own").otherwise("other").alias("c")).groupBy("k", "c").agg(F.count("*").alias("n")).collect()}
    assert got == {("t", "own"): 40_000, ("c", "own"): 1, ("c", "other"): 99_999, ("n", "own"): 1, ("n", "other"): 59}


def test_derived_against_all_pairs():
    import pandas as pd

    rng = np.random.default_rng(61)
    base = rng.integers(0, 1 << 40, 40)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 40), replace=False), rng.integers(0, 60, rng.integers(0, 14))])) for _ in range(120)]
    asks = rng.random(120) < 0.4
    names = np.array([f"c{i:03d}".encode() for i in range(120)], dtype=object)
    pdf = pd.DataFrame({"c": names, "root": names, "main": names[0], "asks": asks, "tokens": sets})
    got = {tuple(r) for r in jaccard._derived(pdf, 75).itertuples(index=False)}
    want = {(names[i], names[j]) for i in np.flatnonzero(asks) for j in np.flatnonzero(~asks) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and want


def test_keep_first_keeps_one_of_equal_rows_and_of_null_ids(spark):
    rng = random.Random(13)
    a, b, c = (" ".join(f"w{rng.randrange(999)}" for _ in range(40)) for _ in range(3))
    rows = [(5, a), (5, a), (5, a), (7, a + " x"), (None, b), (None, b), (None, b + " x"), (None, c), (3, c + " x"), (4, ""), (4, ""), (None, None)]
    kept = jaccard.keep_first(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)
    of_b = [r for r in got if r[1] and r[1].startswith(b)]
    assert len(of_b) == 1 and of_b[0][0] is None
    assert [r for r in got if r not in of_b] == sorted([(5, a), (3, c + " x"), (4, ""), (4, ""), (None, None)], key=repr)


def test_encoder_is_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEEP", 500)
    plain, own = Tokenizer.from_file(tokens.path()), tokens.Encoder(tokens.path())
    rng = random.Random(3)
    alphabet = list("abzAZ .,.,'\"\t\n09<|>-_%$é́İΣẞß中\U0001f600 ​\x1c")
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(8)] + ["<|endoftext|> it's, abc.,", "", None]
        for x, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_encoder_looks_a_word_up_once():
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    plain, own = Tokenizer.from_file(tokens.path()), tokens.Encoder(tokens.path())
    texts = ["Same words, same  words. " * 400, "", None, " \t\n", "<|endoftext|> same words", "same", "\x0bsame\x0c words.\r"] * 20
    own.encode(texts)
    own.young = Counted(own.young)
    ids, counts = own.arrays(texts)
    want = [plain.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert Counted.asked <= 8
    assert [x.tolist() for x in own.arrays([])] == [[], []]
    ids, counts = tokenfile.with_end(ids, counts, 1)
    assert counts.tolist() == [len(x) + 1 for x in want] and ids.tolist() == [i for x in want for i in (*x, 1)]


def test_token_file_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rng, plain = random.Random(4), Tokenizer.from_file(tokens.path())
    texts = [*ODD, *(prose(rng, rng.randint(1, 300)) for _ in range(60)), "thon " * 9000, "same text again", "same text again"]
    ids = [*range(5, len(texts) + 2), None, 1, 1]
    rows = sorted(((i, t) for i, t in zip(ids, texts, strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    tokenfile.write(docs(spark, texts, ids=ids), str(tmp_path / "t"), block=1500)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.agg(F.sum(F.length("rules"))).first()[0] > 0 and stored.count() > 4
    got, at = tokenfile.read(spark, str(tmp_path / "t"), with_ids=True).collect(), 0
    want = []
    for doc, text in rows:
        own = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        want.append((doc, at, len(own) // 4, zlib.crc32(own), own))
        at += len(own) // 4
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=lambda r: r[1]) == want
    tokenfile.write(docs(spark, texts).limit(0), str(tmp_path / "e"))
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 5), (2, 2), (50, 1), (5000, 9), (5000, 60_000 - 49_408)):
        ids = rng.integers(2, 2 + kinds, n).astype("<u4")
        last = rng.random(n) < 0.05
        last[-1] = True
        for base in (49_408, 70_000):
            symbols, rules, lengths, at = tokenfile.compress(ids, last, base, least=2)
            assert symbols.itemsize == tokenfile.width_of(base) and (tokenfile.expand(symbols, rules, base) == ids).all()
            size = np.concatenate([np.ones(base, dtype=int), lengths])[symbols]
            ends = np.cumsum(size)
            assert len(at) == last.sum() and all(last[e - 1] for e in ends[at[1:] - 1])
            assert (np.diff(np.append(at, len(symbols))) > 0).all()


def plain_repair(docs, base, least):
    """Re-Pair by the book: one pair at a time, the most frequent."""
    docs, rules = [list(d) for d in docs], []
    while True:
        count = {}
        for d in docs:
            for p in zip(d, d[1:], strict=False):
                count[p] = count.get(p, 0) + 1
        pair = max(count, key=lambda p: count[p], default=None)
        if pair is None or count[pair] < least:
            return docs, rules
        rules.append(pair)
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                if tuple(d[i : i + 2]) == pair:
                    out.append(base + len(rules) - 1)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out


def test_grammar_against_plain_repair():
    rng = np.random.default_rng(51)
    words = [rng.integers(2, 40, rng.integers(2, 9)) for _ in range(30)]
    passage = rng.integers(2, 900, 200)
    made = [np.concatenate([words[i] for i in rng.integers(0, 30, 60)] + [passage] * int(rng.random() < 0.5)) for _ in range(40)]
    ids, last = np.concatenate(made).astype("<u4"), np.zeros(sum(map(len, made)), dtype=bool)
    last[np.cumsum([len(x) for x in made]) - 1] = True
    want, rules_by_hand = plain_repair(made, 49_408, 8)
    symbols, rules, lengths, at = tokenfile.compress(ids, last, 49_408, least=8)
    size, size_by_hand = len(symbols) + 2 * len(rules), sum(map(len, want)) + 2 * len(rules_by_hand)
    assert size <= 1.05 * size_by_hand and lengths.max() >= 190  # the passage is hardly more than a symbol
    ends = np.zeros(len(symbols), dtype=bool)
    ends[at[1:] - 1], ends[-1] = True, True
    pairs, count = tokenfile.pair_counts(tokenfile.pair_keys(symbols.astype(np.uint32), ends, 16))
    assert count.max() < 8  # nothing that stands often enough is left
    by_hand = {}
    for d in made:
        for p in zip(d.tolist(), d.tolist()[1:], strict=False):
            by_hand[p] = by_hand.get(p, 0) + 1
    pairs, count = tokenfile.pair_counts(tokenfile.pair_keys(ids.astype(np.uint32), last, 16))
    assert {(int(p) >> 16, int(p) & 65_535): int(n) for p, n in zip(pairs, count, strict=True)} == by_hand


def test_window_opens_what_it_needs():
    rng = np.random.default_rng(52)
    passage = rng.integers(2, 900, 500)
    ids = np.concatenate([passage] * 64).astype("<u4")
    last = np.zeros(len(ids), dtype=bool)
    last[-1] = True
    symbols, rules, lengths, at = tokenfile.compress(ids, last, 49_408)
    for start, n in ((0, 1), (31_000, 40), (17, 900), (31_990, 100), (32_000, 5), (5, 0)):
        got, opened = tokenfile.window(symbols, rules, lengths, 49_408, start, n)
        assert got == ids[start : start + n].tolist() and opened <= 2 * n + 2 * 64


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_and_random_access(spark, tmp_path, name):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(tokens.path(name)), random.Random(53)
    assert tokens.Encoder(tokens.path(name)).words == (name == "word_bpe_49k.json")
    texts = [*ODD, *("  Two  Spaces " + prose(rng, 150) for _ in range(30))]
    path = str(tmp_path / "t")
    tokenfile.write(docs(spark, texts), path, tokenizer=tokens.path(name), block=900)
    want = {i: np.array([*plain.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, x in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["ids"]) for r in tokenfile.read(spark, path, with_ids=True).collect()} == {i: x.tobytes() for i, x in want.items()}
    for doc, start, n in ((20, 3, 7), (20, 0, None), (len(texts) - 1, 90, 10_000), (8, 0, 1), (0, 0, 5), (999, 0, 5)):
        got = [bytes(r["ids"]) for r in tokenfile.ids_at(spark, path, doc, start, n).collect()]
        assert got == ([want[doc][start : None if n is None else start + n].tobytes()] if doc in want else [])
    packed = packing.best_fit(docs(spark, texts), tokenizer=tokens.path(name), with_ids=True).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in packed if r["length"] < 2048} == {i: np.append(x[:-1], 0).astype("<u4").tobytes() for i, x in want.items() if len(x) < 2048}


def test_plan_keeps_every_limit():
    rng = random.Random(6)
    for choice in ("norm", "dot"):
        for limits in (packing.Limits(choice=choice), packing.Limits(100, 5, 4000, choice=choice)):
            counts = {rng.randint(1, min(limits.tokens, 60 if limits.tokens == 100 else 2048)): rng.randint(1, 40) for _ in range(50)}
            counts = {n: k for n, k in counts.items() if n * n <= limits.cost}
            plan, used, first = packing.plan(counts, limits), {}, 0
            for at, n, what in plan:
                assert at == first and n > 0
                first += n
                assert sum(a * b for a, b in what) <= limits.tokens and sum(b for _, b in what) <= limits.documents and sum(a * a * b for a, b in what) <= limits.cost
                for a, b in what:
                    used[a] = used.get(a, 0) + n * b
            assert used == counts
            if limits.tokens == 2048:
                room = []
                for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
                    at = min((i for i, r in enumerate(room) if r >= n), key=lambda i: room[i], default=None)
                    if at is None:
                        room.append(2048)
                        at = -1
                    room[at] -= n
                assert first <= len(room) * (1 if choice == "norm" else 1.05)
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.plan({101: 1}, packing.Limits(100))
    assert packing.plan({}) == []


def test_packing(spark):
    from tokenizers import Tokenizer

    rng, plain = random.Random(7), Tokenizer.from_file(tokens.path())
    texts = [*ODD, *(prose(rng, rng.randint(1, 900)) for _ in range(80)), "thon " * 9000, None, None]
    t = docs(spark, texts, ids=[*range(len(texts) - 2), None, None])
    rows = packing.best_fit(t, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
    for i, text in enumerate(texts[:-2]):
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        assert [r["start"] for r in own] == [2048 * k for k in range(len(own))] and all(r["length"] == 2048 for r in own[:-1])
    assert len(by_doc[None]) == 2
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= sum(r["length"] for r in rows) / 2048 * 1.03 + 1
    assert packing.best_fit(t.limit(0)).count() == 0


def vectors(spark, x, ids=None):
    rows = [((ids or range(len(x)))[i], [float(v) if v is not None else None for v in r] if r is not None else None, 1) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(x, ids, queries, k=10):
    x = np.asarray(x, dtype=np.float32).astype(float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 200)
    monkeypatch.setattr(ann, "QUERIES", 5)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 2500)] + 0.6 * rng.normal(size=(2500, 16))
    x[:700] = x[0]  # a third are one vector
    t = vectors(spark, x)
    rows = ann.nearest(t.filter("vec_id % 100 = 0"), t).collect()
    want = exact(x, list(range(2500)), range(0, 2500, 100))
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, near in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(a[2] <= b[2] for a, b in zip(own, own[1:], strict=False))
        hits += len({v for _, v, _ in own} & {v for v, _ in near})
        if q < 700:
            assert [v for _, v, _ in own] == [v for v, _ in near]
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_of_a_large_table(spark, monkeypatch):
    """Far more rows than a router learns from, on one and on two levels: what is scanned and found; and the exact way."""
    rng = np.random.default_rng(81)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 50_000)] + 0.35 * rng.normal(size=(50_000, 16))).astype(np.float32)
    t = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>").cache()
    queries = t.filter("vec_id % 500 = 0")
    want = exact(x, list(range(50_000)), range(0, 50_000, 500))
    for fan in (256, 16):
        monkeypatch.setattr(ann, "FAN", fan)
        tree, size = ann.grow(t.selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding"))
        assert size == 16 and bool(tree.second) == (fan == 16)
        home, y = tree.home(x.astype(float)), x[::500].astype(float)
        counts = dict(zip(*map(np.ndarray.tolist, np.unique(home, return_counts=True)), strict=True))
        rows, parts = tree.routes(y, counts, 10)
        scanned = sum(counts[p] for p in parts.tolist()) / len(y) / 50_000
        got = {}
        for r in ann.nearest(queries, t).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        recall = np.mean([len(got[q] & {v for v, _ in near}) / 10 for q, near in want.items()])
        assert recall >= 0.9 and scanned <= 0.25, (fan, recall, scanned)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(queries, t, reach=1).collect()]
    assert sorted(got) == [(q, i + 1, v) for q, near in sorted(want.items()) for i, (v, _) in enumerate(near)]


def test_queries_go_to_a_block_once():
    """However many partitions a query asks, its vector moves once for each block; partitions over a block's size are dealt over several."""
    counts = {p: 10 + p % 7 for p in range(0, 2000, 2)} | {2001: 950}
    blocks = ann.Blocks.pack(counts, 300)
    n = blocks.blocks[-1]
    assert n <= 2 + 2 * sum(counts.values()) / 300 and all(sum(list(counts.values())[a:e]) <= 300 for a, e in zip(blocks.starts[:-2], blocks.starts[1:-1], strict=True))
    rows, parts = np.repeat(np.arange(5), 600), np.concatenate([np.random.default_rng(i).choice(blocks.parts, 600, replace=False) for i in range(5)])
    got, sent = set(), 0
    for own, block, bits in blocks.asked(rows, parts, 5):
        sent += len(own)
        here = np.flatnonzero((blocks.block <= block) & (block < blocks.block + blocks.split))
        got |= {(q, blocks.parts[here[c]]) for q, b in zip(own.tolist(), np.unpackbits(bits, axis=1), strict=True) for c in np.flatnonzero(b).tolist()}
    assert got == set(zip(rows.tolist(), parts.tolist(), strict=True)) and sent <= 5 * n < len(rows) / 5
    assert blocks.split[-1] == 4 and n == blocks.block[-1] + 4


def test_neighbours_beside_columns_of_the_same_names(spark):
    t = vectors(spark, np.eye(12), [100 * i for i in range(12)]).selectExpr("*", "1 AS part", "'x' AS score", "'y' AS rank", "2 AS rows", "3 AS b", "4 AS asks")
    rows = ann.nearest(t, t, 3).collect()
    assert len(rows) == 36 and all(r["score"] == pytest.approx(2**0.5) for r in rows)


def test_neighbours_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], [0, 1], [1, 1], None, [0, 0], [nan, 1], [1, inf], [None, 1], [1, 2, 3], []]
    t = vectors(spark, x, [0, 100, 2, 3, 4, 5, 200, 7, 300, 400])
    rows = ann.nearest(t.filter("vec_id % 100 = 0"), t).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 2), (0, 100), (100, 2), (100, 0)]
    assert rows[1]["score"] == 2**0.5
    assert ann.nearest(t.limit(0), t).count() == 0 and ann.nearest(t, t.limit(0)).count() == 0
    assert ann.nearest(t.limit(1), t.limit(1)).count() == 0


def test_pipeline(spark, copies):
    rng = random.Random(9)
    texts = [prose(rng, 200) for _ in range(12)] + [f"{c}\n{c.upper()}\nend {i}" for i, c in enumerate([c for c in copies if c and "w1" in c][:40])] + [None, "", "x"]
    t = docs(spark, texts, sources=[rng.choice(["a", "b", None]) for _ in texts])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, t, "")
        if k < 4:
            assert out.dtypes == t.dtypes
        path = tokenfile.fresh_path(spark, "test")
        out.write.parquet(path)
        t = spark.read.parquet(path)
        assert t.count() > 0
    assert t.filter("length > 2048").count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs(spark, ["x"]).limit(0), "").count() == 0


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    df, r = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    want = sorted((tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in columns) for x in df.collect()), key=repr) == want
