"""The token store: exact ids, round trips, unique chunks, verification."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelattice.llm import token_store as ts
from pricelattice.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ENCODER = ts.WordEncoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZéÉ.,'sS!?- \n\t\x1ćß1½Σςσ日İ|<>  Kſ", max_size=16), min_size=1, max_size=4))
def test_ids_are_those_of_whole_texts(texts):
    whole = Tokenizer.from_file(PATH) if not hasattr(ENCODER, "whole") else ENCODER.whole
    ENCODER.whole = whole
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()), 2)
    want = [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


_ADDED = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|endoftext|", "<|end", "|>", "<|", "\u017ftartoftext|>", "a", "B", "é", " ", "\n", ".", ",", "'s", "7"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ADDED), max_size=8).map("".join), min_size=1, max_size=4))
def test_added_tokens_in_any_case(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()), 2)
    want = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_parts_with_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(ts, "word_hashes", lambda data, starts, ends, seed=0: np.full(len(starts), 7, np.uint64))
    encoder = ts.WordEncoder(PATH)
    texts = ["some words, then others", "other words.", ""]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts, pa.string()), 2)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_chunks_depend_on_near_ids_only():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 49_000, 40_000).astype(np.uint32), rng.integers(0, 49_000, 5_000).astype(np.uint32)
    one = ts.chunk_ends(np.concatenate([b, a]), np.array([45_000]))
    two = ts.chunk_ends(a, np.array([40_000]))
    assert len(set((one - 5_000).tolist()) & set(two.tolist())) > 0.9 * len(two)
    assert ts.chunk_ends(np.zeros(30_000, np.uint32), np.array([30_000]))[-1] == 30_000
    assert np.diff(ts.chunk_ends(np.zeros(30_000, np.uint32), np.array([30_000])), prepend=0).max() <= ts.MOST


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=5))
def test_crc_of_joined_parts(parts):
    parts = [p + b"\0" * (-len(p) % 4) for p in parts]
    total = 0
    for p in parts:
        table = ts.crc_shift(len(p))
        moved = 0
        for bit in range(32):
            moved ^= int(table[bit]) if total >> bit & 1 else 0
        total = moved ^ zlib.crc32(p)
    assert total == zlib.crc32(b"".join(parts))


def test_query_equals_the_library(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_token_store"](spark, DATA).collect())) == expected(tokenizer, rows)


def test_round_trip_and_manifest(spark, tokenizer, tmp_path):
    rows = [(5, "Hello, world."), (1, None), (3, ""), (2, "same text here " * 2000), (4, "same text here " * 2000)]
    folder = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int"), folder, PATH)
    assert sorted(map(tuple, ts.read_documents(spark, folder).collect())) == expected(tokenizer, rows)
    ids = {r["doc_id"]: r["ids"] for r in ts.read_ids(spark, folder).collect()}
    assert ids == {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    chunks = ts.read_chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    recipes = {r["doc_id"]: r["chunks"] for r in ts.read_recipes(spark, folder).collect()}
    assert recipes[2] == recipes[4]
    assert ts.verify_manifest(spark, folder).where("not intact").isEmpty()


def test_a_changed_chunk_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), folder, PATH)
    raw = spark.read.parquet(f"{folder}/raw").where("kind = 'chunk'").toPandas()
    bad = spark.createDataFrame([(None, int(raw["n"][0]), bytes(raw["digest"][0]), b"\0" * len(raw["ids"][0]), None)], "doc_id long, n long, digest binary, ids binary, recipe array<binary>")
    bad.withColumn("kind", F.lit("chunk")).write.partitionBy("kind").mode("append").parquet(f"{folder}/raw")
    with pytest.raises(Exception, match="does not match its digest"):
        ts.read_documents(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert ts.read_documents(spark, folder).isEmpty()


def test_merkle_root_sees_order():
    leaves = [bytes([i]) * 16 for i in range(5)]
    assert ts.merkle_root(leaves) != ts.merkle_root(leaves[::-1]) and ts.merkle_root(leaves[:1]) == leaves[0]


def test_a_changed_recipe_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rng = np.random.default_rng(3)
    text = " ".join(f"word{i}" for i in rng.integers(0, 5000, 6000))
    ts.write_store(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), folder, PATH)
    recipes = spark.createDataFrame(ts.read_recipes(spark, folder).collect(), ts.read_recipes(spark, folder).schema)
    chunks = recipes.where("doc_id = 1").first()["chunks"]
    assert len(chunks) > 3
    # The same chunks in another order: digests, counts and the stored root are as before.
    recipes.withColumn("chunks", F.reverse("chunks")).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/recipes")
    with pytest.raises(ValueError, match="Merkle root"):
        ts.read_documents(spark, folder)
    recipes.where("doc_id = 1").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/recipes")
    with pytest.raises(ValueError, match="Merkle root"):
        ts.read_documents(spark, folder)
    recipes.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/recipes")
    assert ts.read_documents(spark, folder).count() == 2


def test_repeated_ids_and_clashing_names(spark, tmp_path, tokenizer):
    folder = f"file://{tmp_path}/store"
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)]
    ts.write_store(spark.createDataFrame([(d, t, 9, "k", 1) for d, t in rows], "doc_id long, text string, part int, kind string, digest int"), folder, PATH)
    got = sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in ts.read_documents(spark, folder).collect())
    sizes = {t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows}
    assert sorted(n for _, _, n in got) == sorted(sizes[t] for _, t in rows) and [d for d, _, _ in got] == [0, 0, 1, 1, 1]
    assert [s for _, s, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(5)]
