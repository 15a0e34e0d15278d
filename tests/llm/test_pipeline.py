"""The pipeline, each stage against brute force on what the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_models import hand_score
from test_near_duplicates import brute as components_by_hand
from test_words_and_suffixes import brute as windows_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from pricelattice.llm import mixing, toxicity
from pricelattice.llm.queries import QUALITY_WEIGHTS

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark):
    out = {"documents": spark.read.parquet(f"{DATA}/documents.parquet").cache()}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, DATA).cache()
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns(tables):
    names = tables["documents"].columns
    assert list(STAGES) == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing_sources", "token_ids"]
    assert all(tables[n].columns == names for n in list(STAGES)[:-1])


def test_toxicity_stage(spark, tables):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(tables["documents"], labels.where(~toxicity.held_out(labels["doc_id"])))
    want = {d for d, t in texts(tables["documents"]) if hand_score(t, model) < 0.7}
    assert {d for d, _ in texts(tables["toxicity"])} == want and 0 < len(want) < tables["documents"].count()


def test_near_dedup_stage(tables):
    least = components_by_hand(texts(tables["toxicity"]))
    want = {d for d, (_, c) in least.items() if d == c}
    got = [d for d, _ in texts(tables["minhash_near_dedup"])]
    assert sorted(got) == sorted(want) and len(want) < len(least)


def test_decontamination_stage(spark, tables):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = windows_by_hand(texts(tables["minhash_near_dedup"]), items)
    assert {d for d, _ in texts(tables["benchmark_decontamination"])} == {d for d, f in found.items() if not f[-1]}


def test_mixing_stage(spark, tables):
    before, after = tables["benchmark_decontamination"], tables["mixing_sources"]
    model = mixing.fit_domains(before, spark.read.parquet(f"{DATA}/labels.parquet"), label_col="quality")
    members = mixing.memberships(before, model).toPandas().set_index("doc_id")
    p, n = np.array(members["posteriors"].tolist()), members["n_tokens"].to_numpy(float)
    natural = (p * n[:, None]).sum(axis=0) / n.sum()
    share = np.array([QUALITY_WEIGHTS[d] for d in model.domains])
    target = share * 1.1 * (natural / share).max()
    rate = np.ones(len(n))
    for _ in range(20_000):
        rate = np.maximum(1, rate - 0.5 * p @ ((p * (n * rate)[:, None]).sum(axis=0) / n.sum() - target))
    copies = Counter(d for d, _ in texts(after))
    assert set(copies) == set(members.index)
    off = np.array([copies[d] for d in members.index]) - rate
    assert np.abs(off).max() < 1.2 and abs(off.mean()) < 0.1  # the whole part, or one more
    rows = {tuple(r) for r in before.collect()}
    assert all(tuple(r) in rows for r in after.collect())


def test_token_stage(tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = []
    for d, t in texts(tables["mixing_sources"]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        rows.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tables["token_ids"].collect())
    assert sorted(r[1:] for r in got) == sorted(rows) and [r[1] for r in got] == sorted(r[0] for r in rows)
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_with_odd_rows(spark, name):
    """NULL ids and texts, empty and repeated rows, clashing names, columns of any type; and no row at all."""
    rows = [(None, "a b c", "x"), (None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 3000, None), (3, "A b  c\nd", "x"), (3, "other text here", "x"), (4, None, None)]
    docs = spark.createDataFrame(
        [(*r, 0, 1.5, "k", [1], {"a": 1, "b": None}, (1, {"x": "y"})) for r in rows],
        "doc_id long, text string, lang string, row int, _rate double, _y string, posteriors array<int>, all map<string,int>, nested struct<a:int,b:map<string,string>>",
    )
    out = STAGES[name](spark, docs, DATA)
    assert out.columns == docs.columns
    got = [r for r in out.collect()]
    # Rows without words stay, repeats of one id once after near-dedup; clean texts stay.
    assert {(r["doc_id"], r["text"]) for r in got} == {(d, t) for d, t, _ in rows}
    assert len(got) == (7 if name == "minhash_near_dedup" else 8) or name == "mixing_sources" and len(got) >= 8
    assert STAGES[name](spark, docs.limit(0), DATA).isEmpty()


def test_run_gives_a_row_for_each_kept_copy(spark, tables):
    assert corpus_pipeline.run(spark, DATA).count() == tables["mixing_sources"].count()
