"""Top-k search, toxicity, mixing and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelattice.llm import mixing, toxicity
from pricelattice.llm.kd_search import KDTree, top_k
from pricelattice.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_top_k(vectors, queries, k):
    out = []
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    data = {i: (rng.integers(-3, 4, 6) / 7).astype(np.float32).tolist() for i in range(700)}
    data |= {1000 + i: [0.5] * 6 for i in range(400)}  # one very common vector: ties
    rows = [(i, v, 0) for i, v in data.items()]
    rows += [(5000, None, 0), (5001, [1.0] * 5 + [float("nan")], 0), (5002, [float("inf")] + [0.0] * 5, 0), (5003, [1.0] * 3, 0), (5004, [None] + [9.0] * 5, 0), (None, [9.0] * 6, 0), (3, data[3], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    grid = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in data.items()}
    asked = {i: grid[i] for i in grid if i % 50 == 0}
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0 and vec_id < 5000"), 10, shard_rows=200).collect()))
    assert got == brute_top_k(grid, asked, 10)
    few = df.where("vec_id in (0, 50, 7)")
    assert top_k(few, few.where("vec_id = 0"), 10).count() == 2
    assert top_k(df.limit(0), df).isEmpty() and top_k(df, df.limit(0)).isEmpty()


def test_top_k_with_an_id_repeated_at_the_top(spark):
    rng = np.random.default_rng(6)
    data = {i: (rng.integers(-3, 4, 4) / 8).tolist() for i in range(300)}
    rows = list(data.items()) + [(900, [4.0 + j % 10] * 4) for j in range(20)] + [(901, [3.0] * 4)] * 20
    df = spark.createDataFrame(rows + [(902, [1.0] * 4)], "vec_id long, embedding array<float>")
    grid = {i: [int(1024 * x) for x in v] for i, v in data.items()} | {900: [13 * 1024] * 4, 901: [3 * 1024] * 4, 902: [1024] * 4}
    want = brute_top_k(grid, {902: grid[902]}, 10)
    for size in (16_384, 50):
        assert sorted(map(tuple, top_k(df, df.where("vec_id = 902"), 10, shard_rows=size).collect())) == want


def test_boxes_bound_their_vectors_and_prune():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 3)) * 1024)
    tree = KDTree(np.arange(4000), x)
    q = np.floor(rng.normal(size=(20, 3)) * 1024)
    bounds = tree.bounds(q)
    for node, (lo, hi) in enumerate(tree.ranges):
        assert (tree.vectors[lo:hi] @ q.T <= bounds[:, node] + 1e-6).all()
    for i, scores, ids in tree.search(q, np.full(20, -1), 5, np.full(20, -np.inf)):
        assert scores.tolist() == np.sort(x @ q[i])[::-1][:5].tolist()


def test_cells_prune_and_split(spark):
    """Clustered vectors in many cells, one vector of many ids that fills a cell's shards, queries from empty corners."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 3)) * 4
    data = {i: (centres[i % 12] + rng.normal(size=3) * 0.1).tolist() for i in range(1500)} | {3000 + i: [2.0, 2.0, 2.0] for i in range(700)}
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    asked = {-1 - i: (rng.normal(size=3) * 9).tolist() for i in range(15)} | {i: data[i] for i in (0, 5, 3001)}
    queries = spark.createDataFrame(list(asked.items()), "vec_id long, embedding array<double>")
    grid = {i: [int(np.floor(1024 * x)) for x in v] for i, v in data.items()}
    got = sorted(map(tuple, top_k(df, queries, 10, shard_rows=60).collect()))
    assert got == brute_top_k(grid, {i: [int(np.floor(1024 * x)) for x in v] for i, v in asked.items()}, 10)
    empty = spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<double>")
    assert top_k(empty, empty).isEmpty()


def outputs(text):
    words = {"idiot": ("I", 1.0), "kill": ("T", 1.0), "you": ("Y", 1.0), "not": ("N", 1.0), "said": ("R", 1.0), "will": ("M", 1.0)}
    model = toxicity.ToxicityModel(words, np.zeros(8))
    import pyarrow as pa

    x, _ = toxicity.clause_features(pa.array([text], pa.string()), model.tables(), toxicity.grammar())
    return {s: v for s, v in zip(toxicity.OUTPUT, x[0]) if v}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("what an idiot", {"I": 1}), ("You are an IDIOT!", {"J": 1}), ("you are not an idiot", {"n": 1}), ("he said idiot", {"r": 1}), ("he said. Idiot", {"I": 1}),
        ("I will kill you", {"H": 1}), ("kill the lights", {"T": 1}), ("I will not kill", {"n": 1}), ("nothing here", {}), ("", {}), (None, {}), ("not. idiot", {"I": 1}),
        ("idiot, idiot; idiot", {"I": 3}), ("you one two three four five idiot", {"I": 1}),
    ],
)
def test_grammar(text, want):
    assert outputs(text) == want


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text, model):
    """The grammar's sums as four rewritings of each clause, one word after another."""
    longest = sorted(model.openings, key=len, reverse=True)
    sums = dict.fromkeys(toxicity.OUTPUT, 0.0)
    n_words = 0
    for clause in re.split(rb"[.!?;:|\n\r]", (text or "").encode()):
        words = [w.decode() for w in WORD.findall(clause.lower())]
        n_words += len(words)
        marked = []
        for w in words:
            opening = next((o for o in longest if w.startswith(o) and len(w) > len(o)), None)
            marked.append(model.lexicon.get(w) or (("S", model.openings[opening]) if opening else ("O", 1.0)))
        symbols, weights = [x for x, _ in marked], [w for _, w in marked]
        left = 0
        for i, x in enumerate(symbols):  # negation
            if x in "ITS" and left:
                symbols[i] = "n"
            left = 3 if x == "N" else max(0, left - 1)
        told = False
        for i, x in enumerate(symbols):  # reported speech
            if told and x in "IST":
                symbols[i] = "u" if x == "T" else "r"
            told = told or x == "R"
        left = 0
        for i, x in enumerate(symbols):  # threats
            if x == "T" and left:
                symbols[i], left = "H", 0
            else:
                left = 3 if x == "M" else max(0, left - 1)
        left = 0
        for i, x in enumerate(symbols):  # targets
            if x in "IH" and left:
                symbols[i] = "J" if x == "I" else "H"
                weights[i] *= 1.5 if x == "H" else 1.0
                left = 4
            else:
                left = 4 if x == "Y" else max(0, left - 1)
        for x, w in zip(symbols, weights):
            if x in sums:
                sums[x] += w
    return [*sums.values(), n_words]


def hand_score(text, model):
    return float(model.score(np.array([by_hand(text, model)]))[0])


def test_scores_equal_rewriting_by_hand(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    model.openings |= {"thi": 0.5, "éré": 0.3, "der": 0.7}  # frequent ones, as a small sample may teach none
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert all(abs(got[r["doc_id"]] - hand_score(r["text"], model)) < 1e-9 for r in rows) and len({round(x, 6) for x in got.values()}) > 100
    extra = ["you will not kill an idiot said they", "they said you idiot will kill you. Kill him, thing and derder!", "nobody, idiot idiot\nidiot you are idiot", "thi thi7 thinking you idiot|will will kill kill"]
    assert [round(r["score"], 9) for r in toxicity.toxicity(spark.createDataFrame(list(enumerate(extra)), "doc_id int, text string").coalesce(1), model).collect()] == [round(hand_score(t, model), 9) for t in extra]


def test_openings_are_learned_from_different_words_only(spark):
    rng = np.random.default_rng(5)
    filler = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        w = rng.choice(filler, 12).tolist()
        if i % 4 == 0:
            w[int(rng.integers(12))] = f"grob{'abcdefghijk'[int(rng.integers(11))]}"
        if i % 8 == 0:
            w = [*texts[0][0].split()[:-1], f"w{i % 80}"] if texts and i % 16 == 0 else w  # near copies of one toxic text
        texts.append((" ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    assert "grob" in model.openings and not any(w.startswith("w") for w in (*model.openings, *model.lexicon) if w[1:].isdigit())


def test_toxicity_recall_in_every_language(spark):
    data = "/root/testdata/sf0.1"
    got = QUERIES["op3_toxicity"](spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    pdf = got.join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    found = pdf[pdf["toxic"] == 1].groupby("lang")["predicted"].mean()
    assert pdf[pdf["toxic"] == 1]["predicted"].mean() >= 0.85 and found.min() > 0.4
    assert (pdf[pdf["toxic"] == 0]["predicted"] == 0).mean() >= 0.98


def test_toxicity_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, data)
    pdf = got.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    test = pdf[pdf["held_out"]]
    assert len(test) and ((test["score"] >= 0) & (test["score"] <= 1)).all()
    assert (test[test["predicted"] == 1]["toxic"] == 1).mean() > 0.95
    assert (test["predicted"] == test["toxic"]).mean() > 0.9
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_toxicity_without_labels_and_edge_cases(spark):
    docs = spark.createDataFrame([(1, "you are an idiot", 0.5), (2, None, 0.5), (3, "", 0.5), (None, "fine", 0.5), (4, "word " * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert got[1] > 0.7 and max(got[2], got[3], got[None], got[4]) < 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.toxicity(docs.limit(0), model).isEmpty()


def test_mixing_reaches_its_targets(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    train = labels.where(F.col("doc_id") % 2 == 0)
    model = mixing.fit_domains(docs, train, label_col="quality")
    members = mixing.memberships(docs, model).cache()
    pdf = members.join(labels.where(F.col("doc_id") % 2 == 1), "doc_id").toPandas()
    guess = [model.domains[int(np.argmax(p))] for p in pdf["posteriors"]]
    assert np.mean([g == str(q) for g, q in zip(guess, pdf["quality"])]) > 0.95
    for weights, least, headroom in (({"0": 0.5, "1": 0.5}, 0.0, None), ({"0": 0.02, "1": 0.98}, 0.0, None), ({"0": 0.2, "1": 0.8}, 1.0, 1.1)):
        mix = mixing.fit_rates(members, model, weights, least=least, headroom=headroom)
        rates = mixing.mixed_rates(members, mix).toPandas()
        p = np.array(rates["posteriors"].tolist())
        share = (rates["n_tokens"].to_numpy()[:, None] * rates["rate"].to_numpy()[:, None] * p).sum(axis=0)
        assert np.allclose(share / share.sum(), [weights["0"], weights["1"]], atol=1e-3) and rates["rate"].min() >= least
    copies = mixing.mixed(docs, mix)
    assert copies.columns == docs.columns and copies.select("doc_id").distinct().count() == docs.count()
    assert abs(copies.count() - rates["rate"].sum()) < 0.05 * docs.count()


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "a b", 9.0), (3, "x " * 100_000, 9.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = mixing.fit_domains(docs, none, label_col="quality")
    members = mixing.memberships(docs, model)
    mix = mixing.fit_rates(members, model, {"1": 1.0})
    assert [round(r["rate"], 6) for r in mixing.mixed_rates(members, mix).collect()] == [1.0] * 4
    assert mixing.mixed(docs, mix).count() == 4
    assert mixing.fit_rates(members.limit(0), model, {"1": 1.0}).moves == []


def test_rates_equal_brute_force(spark):
    """The query's rates on whole tables against projected gradient with all documents in memory."""
    got = QUERIES["op7_mixing"](spark, DATA).toPandas().sort_values("doc_id")
    p, n, rate = np.array(got["posteriors"].tolist()), got["n_tokens"].to_numpy(float), got["rate"].to_numpy()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id")
    assert got["doc_id"].tolist() == docs["doc_id"].tolist() and n.tolist() == [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in docs["text"]]
    a = (p * n[:, None]).T / n.sum()
    target, r = np.array([0.1, 0.9]), np.ones(len(n))
    for _ in range(20_000):  # fixed short steps, in the metric that counts documents by their tokens
        r = np.maximum(0, r - 0.5 * p @ (a @ r - target))
    assert np.abs(a @ r - target).max() < 1e-6 and np.abs(a @ rate - target).max() < 1e-5
    assert (rate >= 0).all()
    cost = lambda x: (n * (x - 1) ** 2).sum() / n.sum()
    assert abs(cost(rate) - cost(r)) < 0.05 * cost(r)


def test_a_target_out_of_reach_is_reported(spark):
    model = mixing.DomainModel(["0", "1"], np.zeros(1), np.ones(1), np.zeros((2, 2)))
    members = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(20)], "doc_id long, n_tokens long, posteriors array<double>")
    with pytest.raises(ValueError, match="out of reach"):
        mixing.fit_rates(members, model, {"0": 0.1, "1": 0.9}, rounds=10)


def test_mixed_keeps_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(i % 4, "a b c", 1.5, 2, {"k": i}) for i in range(8)], "doc_id long, text string, _rate double, _copy int, row map<string, int>")
    model = mixing.DomainModel(["0"], np.zeros(mixing._N_FEATURES), np.ones(mixing._N_FEATURES), np.zeros((mixing._N_FEATURES + 1, 1)))
    out = mixing.mixed(docs, mixing.Mixture(model, 0.0, [np.array([-2.0])]))  # every rate is 3
    assert out.columns == docs.columns and out.count() == 24 and {r["_rate"] for r in out.collect()} == {1.5}
    assert mixing.mixed(docs, mixing.Mixture(model, 0.0, [np.array([1.0])])).isEmpty()
