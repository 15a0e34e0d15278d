"""Packed keys, phrase collocations and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelattice.llm import packed, phrases, resample
from pricelattice.llm.words import ALNUM, lowered, word_bounds

DATA = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=30))
def test_packed_numbers_come_back(values):
    assert packed.unpack(packed.pack(np.array(values, np.int64))).tolist() == values
    keys = np.unique(np.array(values, np.int64))
    assert packed.unpack_keys(packed.pack_keys(keys)).tolist() == keys.tolist()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def counted(docs, longest):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, " ".join(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, {k: v for k, v in n.items() if v}


def best(docs, least, longest, percent, most):
    f, n = counted(docs, longest)
    cands = {k: v for k, v in f.items() if v >= least and " " in k[1]}
    out = []
    for (lang, p), a in cands.items():
        w = p.split(" ")
        cuts = [(1_000_000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if any(lng == lang and f" {p} " in f" {q} " and q != p and 100 * b >= percent * a for (lng, q), b in cands.items()):
            continue
        out.append((lang, -score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    ranked, at = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        at[lang] += 1
        if at[lang] <= most:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


ODD = [
    ("en", "A b  a\tb. A B a b; a a a a a a"), ("en", None), ("en", ""), (None, "x y x y x y, x y z"), ("und", "x y"), ("en", ".,;:!?\n\n"), ("de", "é É Éß ß ß ß\x00 ß ß ß"),
    ("de", "日本 語 日本 語 日本 語\r\nü"), ("en", "a b " * 3000), ("en", "a b " * 3000), ("fr", "w" * 200_000 + " " + "w" * 200_000), ("", "p q p q p q"),
]


@pytest.mark.parametrize("longest,least,percent,most", [(3, 2, 50, 2000), (4, 3, 80, 3), (2, 1, 50, 2000)])
def test_collocations_equal_brute_force(spark, longest, least, percent, most, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 4000)
    docs = spark.createDataFrame([(lang, text, i, "s") for i, (lang, text) in enumerate(ODD)], "lang string, text string, score int, shard string").repartition(3)
    got = phrases.collocations(docs, least=least, longest=longest, inside_percent=percent, most=most).collect()
    assert sorted(tuple(r) for r in got) == best(ODD, least, longest, percent, most)


def test_counts_do_not_depend_on_the_sketch(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    f, n = counted([(r["lang"], r["text"]) for r in docs.collect()], 3)
    want = sorted((lang, p, c) for (lang, p), c in f.items() if c >= 10)
    for bits in (4, 16, 25):  # a few cells, in which all phrases meet, or many ranges
        counts, words = phrases.phrase_counts(docs, bits=bits)
        assert sorted((r["lang"], r["phrase"], r["n"]) for r in counts.collect()) == want
        assert {r["lang"]: r["n"] for r in words.collect()} == n


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(phrases, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    got = {size: len(set(own.tolist())) for size, _, own, _, _, _ in phrases._phrases(b" a b a b c \n b a ", 2)}
    assert got == {1: 3, 2: 3}


def test_long_pieces_and_empty_tables(spark, monkeypatch):
    parts = list(phrases._cut(phrases.plain_pieces(b"one two." * 100), 120))
    assert all(len(p) < 200 for p in parts) and sum(p.count(b"two") for p in parts) == 100
    assert list(phrases._cut(b" w" * 500, 100)) == [b" w" * 500]
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).isEmpty()
    assert phrases.collocations(spark.createDataFrame([("en", "  ")], none.schema)).isEmpty()


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(10**13 + 7, 10**13 + 9, 10**13 + 8), (3 * 10**12, 3 * 10**12, 10**14 - 1), (10, 10, 10)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = [r[0] for r in df.select(phrases._ratio(df["a"], df["l"], df["r"])).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in big]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def features(text, longest=3):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBzé0ß日 .-\n", max_size=90), min_size=1, max_size=4), st.integers(1, 4))
def test_hashes_are_those_of_the_joined_words(texts, longest):
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, first = word_bounds(data, at, ALNUM)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    crc = resample.word_crcs(lowered(data), starts, ends)
    got = [x for _, found in resample.run_crcs(crc, ends - starts, own, longest) for x in found.tolist()]
    assert Counter(got) == Counter(zlib.crc32(f.encode()) for t in texts for f in features(t, longest))


def drawn(docs, goal, percent, least_words, buckets):
    s, t = Counter(), Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for _, text in docs:
        s.update(map(bucket, features(text)))
    for text in goal:
        t.update(map(bucket, features(text)))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_WORDS", 40)
    monkeypatch.setattr(resample, "BLOCK_DOCS", 3)
    docs = [(i, f"The cat {i % 3} sat, on mat {i} " * (i % 5)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "..."), (7, "a cat"), (7, "a cat"), (None, "the cat sat on it " * 4), (103, "ß Σ日 " * 60), (104, "word " * 2000)]
    goal = ["the cat sat on the mat", None, "", "Σ日 ß ß"]
    df = spark.createDataFrame([(i, t, 1.0, 0) for i, t in docs], "doc_id long, text string, score double, range int").repartition(3)
    for wanted in (goal, []):
        target = spark.createDataFrame([(t, 1) for t in wanted], "text string, weight int")
        rows_, top = drawn(docs, wanted, 30, 5, 97)
        got = resample.resample(df, target, percent=30, least_words=5, buckets=97).collect()
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted((r[:4] for r in rows_), key=key)
        ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(top) + 1)) and [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[3]) for r in top]
    assert resample.resample(df.limit(0), target).isEmpty()


def test_resampling_of_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "four"), (None, "five")], "name string, body string")
    got = resample.resample(docs, spark.createDataFrame([("one two",)], "body string"), percent=100, least_words=1, id_col="name", text_col="body").collect()
    assert {r["name"]: r["n_features"] for r in got} == {"a": 6, "b": 1, None: 1} and sorted(r["rank"] for r in got) == [1, 2, 3]
