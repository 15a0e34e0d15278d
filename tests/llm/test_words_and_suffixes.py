"""Word hashing and benchmark decontamination against brute force."""

import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelattice.llm import suffix_search as ss
from pricelattice.llm.queries import QUERIES
from pricelattice.llm.words import ALNUM, SPACES, pieces, same_words, text_bytes, word_bounds, word_hashes

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=10):
    wanted: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wanted}:
            for k in range(len(w) - size + 1):
                if own := wanted.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        names = sorted(found)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é.\n\x00", max_size=12), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((ALNUM, WORD), (~SPACES, re.compile(rb"[^\x20\x09-\x0D]+"))):
        data, at = text_bytes(pa.array(texts, pa.string()))
        starts, ends, first = word_bounds(data, at, table)
        found = [bytes(data[s:e]).lower() for s, e in zip(starts, ends)]
        per_text = [pattern.findall(t.encode().lower()) for t in texts]
        assert found == [w for ws in per_text for w in ws]
        assert (first[1:] - first[:-1]).tolist() == [len(ws) for ws in per_text]
        hashes = word_hashes(data, starts, ends).tolist()
        assert len({*zip(found, hashes)}) == len({*found}) == len({*hashes})


def test_pieces_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "text": [None if i % 7 == 0 else "x" * (i * i % 90) for i in range(50)]})
    for limit in (1, 50, 10_000):
        got = [i for b in pieces(iter([batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)]), "text", limit) for i in b.column(0).to_pylist()]
        assert got == list(range(50))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=60), min_size=1, max_size=5), st.lists(st.text(alphabet="abc ", max_size=30), max_size=4), st.integers(1, 4))
def test_shard_search_equals_brute_force(docs, items, window):
    block = ss.TestBlock.of([str(i) for i in range(len(items))], items, window)
    found = ss.search_shard(pa.array(docs, pa.string()), block)
    want = brute(list(enumerate(docs)), list(enumerate(items)), window)
    for d in range(len(docs)):
        assert found["n_words"][d] == want[d][0]
        assert sum(e - s for s, e in found["spans"][d]) == want[d][1]
        assert len(set(found["items"][d])) == want[d][2]


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_benchmark_decontamination"](spark, DATA).collect()}
    assert got == brute(docs, items)


def test_edge_cases_and_several_blocks(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, None, "x"), (3, "", "x"), (None, "z a b c", "x"), (4, "long " * 50_000 + "a b c", "x")],
        "doc_id long, text string, items string",
    )
    items = spark.createDataFrame([("p", "A-b.C"), ("p", "a b c"), ("q", "d"), ("r", ""), (None, "z")], "item_id string, text string")
    small = ss.benchmark_matches(docs, items, window=3, block_bytes=1)
    large = ss.benchmark_matches(docs, items, window=3)
    plain = lambda df: sorted((r["doc_id"] or 0, r["n_words"], str(r["spans"]), r["items"]) for r in df.collect())
    assert plain(small) == plain(large)
    assert {(r["doc_id"], tuple(r["items"])) for r in large.collect()} == {(1, ("p", "q")), (2, ()), (3, ()), (None, ("p",)), (4, ("p",))}
    kept = ss.without_matches(docs, items, window=3)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert ss.benchmark_matches(docs, items.limit(0)).where("size(spans) > 0").isEmpty()
    assert ss.benchmark_matches(docs.limit(0), items).isEmpty()


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "q a b c d e f")], "item_id string, text string")
    assert ss.benchmark_matches(docs, items, window=2).first()["longest"] == 5


def thue_morse(n):
    """Two words of 2**n letters that polynomial hashes modulo a power of 2 cannot tell apart."""
    flip = str.maketrans("ab", "ba")
    w = "a"
    for _ in range(n):
        w += w.translate(flip)
    return w, w.translate(flip)


def test_words_made_to_collide_do_not():
    for n in (3, 5, 6, 7, 10, 12):
        data, at = text_bytes(pa.array(thue_morse(n)))
        for seed in range(3):
            assert len(set(word_hashes(data, at[:-1], at[1:], seed).tolist())) == 2
    block = ss.TestBlock.of(["p"], [thue_morse(10)[0]], 10)
    assert ss.search_shard(pa.array([thue_morse(10)[1], thue_morse(10)[0].upper()]), block)["items"] == [[], ["p"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aAb", max_size=90), st.text(alphabet="aAb", max_size=90), st.booleans()), max_size=6))
def test_same_words_compares_bytes(pairs):
    pairs = [(x, x.swapcase() if same else y) for x, y, same in pairs]
    (a, i), (b, j) = (text_bytes(pa.array(c, pa.string())) for c in ([x for x, _ in pairs], [y for _, y in pairs]))
    assert same_words(a, i[:-1], i[1:], b, j[:-1], j[1:]).tolist() == [x.lower() == y.lower() for x, y in pairs]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=60), min_size=1, max_size=5), st.lists(st.text(alphabet="abc ", max_size=30), max_size=4))
def test_search_where_every_hash_collides(docs, items):
    """With one hash for all words each seed fails to confirm, and bytes decide."""
    own = ss.word_hashes
    try:
        ss.word_hashes = lambda data, starts, ends, seed=0: ends * 0 + 7
        block = ss.TestBlock.of([str(i) for i in range(len(items))], items, 3)
        found = ss.search_shard(pa.array(docs, pa.string()), block)
    finally:
        ss.word_hashes = own
    want = brute(list(enumerate(docs)), list(enumerate(items)), 3)
    assert [(sum(e - s for s, e in found["spans"][d]), len(found["items"][d])) for d in range(len(docs))] == [want[d][1:3] for d in range(len(docs))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=4), st.lists(st.text(alphabet="ab ", max_size=30), max_size=4))
def test_longest_match_equals_brute_force(docs, items):
    found = ss.search_shard(pa.array(docs, pa.string()), ss.TestBlock.of([str(i) for i in range(len(items))], items, 3))

    def common(x, y):
        n = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        return n if n >= min(3, len(whole)) and (n >= 3 or len(y) == len(whole)) else 0

    for d, text in enumerate(docs):
        w, best = text.split(), 0
        for item in items:
            whole = item.split()
            best = max([best, *(common(w[i:], whole[j:]) for i in range(len(w)) for j in range(len(whole)))])
        assert found["longest"][d] == best
