"""Near-duplicates against brute force over full sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pricelattice.llm import lsh_forest as lf
from pricelattice.llm.graph import components
from pricelattice.llm.lsh_forest import near_duplicates
from pricelattice.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < 85 * large:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def check(spark, rows):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_families_of_copies(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, doc = [], 0
    for family in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((doc, rng.choice([" ", "\n", "  "]).join(text).replace("w1", rng.choice(["w1", "W1"]))))
            doc += 1
    check(spark, rows)


def test_one_hot_family(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for doc in range(700):  # beyond a region's size, so that regions go deeper
        text = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            text[rng.randrange(100)] = f"x{rng.randrange(5)}"
        rows.append((doc, " ".join(text)))
    check(spark, rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four"), (8, "é" * 50_000), (9, "x y"), (10, "x y")]
    check(spark, rows)
    more = spark.createDataFrame([(4, "one", "t"), (4, "one", "t"), (None, "one", "t")], "doc_id long, text string, component_id string")
    got = sorted(near_duplicates(more).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got] == [(None, None, True), (4, 4, True), (4, 4, True)]
    assert near_duplicates(more.limit(0)).isEmpty()


def test_query_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_minhash_near_dedup"](spark, data).collect()}
    assert got == brute(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_rows_that_share_an_id_or_have_none(spark):
    words = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    a, b, c, d = words("a"), words("b"), words("c"), words("d")
    rows = [(7, a), (7, b), (7, b), (3, b + " more"), (None, c), (None, c), (None, c + " more"), (None, a), (None, d), (7, ""), (7, ""), (None, None), (8, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])[:2]) for r in kept if r["text"] and not r["text"].startswith("c0")) == [("3", "b0"), ("7", "a0"), ("None", "d0")]
    assert sum((r["text"] or "").startswith("c0") for r in kept) == 1 and sorted(r["place"] for r in kept if not r["text"]) == [9, 11, 12]
    assert len(kept) == 7 and {r["place"] for r in kept} == {r["place"] for r in corpus_pipeline.near_dedup(spark, df.repartition(5, "place"), "").collect()}
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df.where("text <> ''")).collect()}
    assert got == {(7, 7, True), (7, 3, False), (3, 3, True), (None, None, True)}


def linked_pairs(rows, percent=85):
    """All linked pairs of different sets: rare shingles first, linked sets share one of the first few."""
    sets = {}
    for d, t in sorted(rows):
        own = frozenset(map(hash, shingles(t)))
        if own and own not in sets:
            sets[own] = d
    count = Counter(x for s in sets for x in s)
    by = defaultdict(list)
    pairs = set()
    for s, d in sets.items():
        for x in sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]:
            for other, e in by[x]:
                both = len(s & other)
                if 100 * both >= percent * (len(s) + len(other) - both):
                    pairs.add((d, e))
            by[x].append((s, d))
    return pairs


def test_recall_over_ten_thousand_documents(spark):
    data = "/root/testdata/sf0.1"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    own = {r["doc_id"]: r["component_id"] for r in QUERIES["op5_minhash_near_dedup"](spark, data).collect()}
    pairs = linked_pairs(rows)
    assert len(pairs) > 10 and np.mean([own[a] == own[b] for a, b in pairs]) >= 0.999
    known = {frozenset(map(hash, shingles(t))): d for d, t in sorted(rows, reverse=True)}
    least = {d: known[frozenset(map(hash, shingles(t)))] for d, t in rows if t and t.split()}
    reach = {r["node"]: r["component"] for r in components(spark.createDataFrame([*pairs, (-1, -2)], "a long, b long")).collect()}
    assert all(own[d] == reach.get(k, k) for d, k in least.items())  # no link that is none


def test_cut_regions_stay_connected(monkeypatch):
    """One hot region in three partitions and many buffers: links within them and across their borders connect all."""
    monkeypatch.setattr(lf, "BUFFER", 300)
    monkeypatch.setattr(lf, "REGION", 64)
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 256, lf._VALUES // 4, dtype=np.uint8).tobytes()
    key = rng.integers(0, 1 << 32, (2000, lf.DEPTH)).astype(">u4")
    key[:, : lf.LEAST_DEPTH] = 7
    order = sorted(range(2000), key=lambda i: key[i].tobytes())
    table = pa.Table.from_pydict({
        "tree": pa.array([0] * 2000, pa.int32()), "key": [key[i].tobytes() for i in order], "doc_id": order, "n_shingles": [50] * 2000, "sketch": [bits] * 2000,
    })
    found = [pa.Table.from_batches(lf._candidates(85)(iter(part.to_batches(max_chunksize=100)))) for part in (table.slice(0, 700), table.slice(700, 1), table.slice(701))]
    both = pa.concat_tables(found).to_pandas()
    border = both[both["a"].isna()].drop(columns=["a", "b"]).drop_duplicates(["doc_id"]).astype({"doc_id": "int64", "n_shingles": "int64"}).sort_values(["tree", "key", "doc_id"])
    more = pa.Table.from_batches(lf._candidates(85)(iter(pa.Table.from_pandas(border, preserve_index=False).to_batches()))).to_pandas()
    up = list(range(2000))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for frame in (both, more):
        for a, b in frame.dropna(subset=["a"])[["a", "b"]].astype(int).to_numpy().tolist():
            up[top(a)] = top(b)
    assert len({top(i) for i in range(2000)}) == 1


def test_words_made_to_collide_are_different_shingles(spark):
    flip = str.maketrans("ab", "ba")
    w = "a"
    for _ in range(10):
        w += w.translate(flip)
    check(spark, [(1, w), (2, w.translate(flip)), (3, w.upper())])
