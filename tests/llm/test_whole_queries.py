"""The registered queries, and the pipeline stage by stage, over the smallest tables against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from candela.llm import queries, secrets, tokenfile, tokens
from tests.llm.test_corpus import exact, groups_by_hand, near_by_hand
from tests.llm.test_rows import WORD, dedup_by_hand, secrets_by_hand, targets_by_hand

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def ids(documents):
    plain = Tokenizer.from_file(tokens.path())
    return {d: plain.encode(t or "", add_special_tokens=False).ids for d, t, *_ in documents}


def packed_well(rows, want):
    """Pieces of 2048 hold the documents' ids, and sequences of them have no gaps."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    pieces = lambda x: [(k, 2048 * k, len(x[2048 * k :][:2048]), zlib.crc32(np.array(x[2048 * k :][:2048], dtype="<u4").tobytes())) for k in range(-(-len(x) // 2048))]
    for d, texts in want.items():
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc.pop(d)) == sorted(p for x in texts for p in pieces([*x, 0]))
    assert not by_doc


def test_op2(spark, documents):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in queries.op2_jaccard(spark, DATA).collect())
    assert got == near_by_hand([(d, t) for d, t, *_ in documents])


def test_op3(spark, ids):
    packed_well(queries.op3_best_fit(spark, DATA).collect(), {d: [x] for d, x in ids.items()})


def test_op5(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    names, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    want, got = exact(x, names, [v for v in names if v % 100 == 0]), {}
    for r in queries.op5_nearest(spark, DATA).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        own, of = sorted(got[q]), dict(zip(names, x, strict=True))
        assert [r for r, *_ in own] == list(range(1, 11)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(s == pytest.approx(np.sqrt(((of[v].astype(float) - of[q].astype(float)) ** 2).sum()), rel=1e-12) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for v, _ in near})
    assert hits >= 0.9 * 10 * len(want)


def test_op6(spark, documents):
    got = {r["doc_id"]: r for r in queries.op6_language(spark, DATA).collect()}
    held = [(d, lang) for d, t, lang, _ in documents if zlib.crc32(str(d).encode()) % 5 == 0 and t and lang]
    assert len(got) == len(documents) and all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in documents)
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)


def test_op8(spark, documents, ids):
    got, at = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_file(spark, DATA).collect()}, 0
    for d in sorted(ids):
        own = np.array([*ids[d], tokenfile.END], dtype="<u4")
        assert got[d] == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert len(got) == len(documents)


def test_op10(spark, documents):
    got = {r["doc_id"]: r for r in queries.op10_secrets(spark, DATA).collect()}
    assert len(got) == len(documents)
    for d, text, *_ in documents:
        want = secrets_by_hand(text)
        base = [w for w in want if w[3] in secrets.BASE]
        assert got[d]["spans"] == ",".join(f"{n}:{a}:{b}" for a, _, b, n in want)
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in base).encode()).hexdigest()


def test_pipeline(spark, documents, ids):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.SQL['op9_quality']}) WHERE kept").fetchall()}
    t, stages = spark.read.parquet(f"{DATA}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns, kept = t.columns, {d: x for d, x, *_ in documents if d in good}

    def after(name):
        nonlocal t
        path = tokenfile.fresh_path(spark, "stage")
        stages[name](spark, t, DATA).write.parquet(path)
        t = spark.read.parquet(path)
        return t.collect()

    rows = after("quality rules")
    assert t.columns == columns and {r["doc_id"]: r["text"] for r in rows} == kept
    want = {d: new for (d, text), (new, _, gone) in dedup_by_hand(list(kept.items())).items() if not gone or WORD.search(new)}
    assert {r["doc_id"]: r["text"] for r in after("line dedup")} == want and t.columns == columns
    rows = list(want.items())
    sets, group = groups_by_hand(rows)
    first = {}
    for (d, _), g in zip(rows, group, strict=True):
        first[g] = min(first.get(g, d), d)
    once = {d: want[d] for d in first.values()}
    assert {r["doc_id"]: r["text"] for r in after("n-gram Jaccard join")} == once and t.columns == columns
    source, sizes = {d: s for d, _, _, s in documents}, {}
    for d, x in once.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(WORD.findall(x))
    taken, mixed = {}, after("mixing")
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert once[r["doc_id"]] == r["text"] or WORD.findall(once[r["doc_id"]])[: len(WORD.findall(r["text"]))] == WORD.findall(r["text"])
    assert t.columns == columns and pd.Series(taken).to_dict() == pytest.approx(targets_by_hand(sizes), abs=1)
    plain, texts = Tokenizer.from_file(tokens.path()), {}
    for r in mixed:
        texts.setdefault(r["doc_id"], []).append(plain.encode(r["text"], add_special_tokens=False).ids)
    rows = after("best-fit packing")
    packed_well(rows, texts)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
