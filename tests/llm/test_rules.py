"""Quality rules: compiled columns against conditions read by hand, held-out accuracy, odd rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from pricelattice.llm import rules
from pricelattice.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def by_hand(text):
    t = " " + (text or "")
    share = lambda rest: (len(t) - len(rest)) / len(t) if len(t) > 1 else 0.0
    out = {"length": math.log(len(t))}
    letter, upper = "[^\\W\\d_]", "[A-ZÉÀÖÄÜ]"
    plain = {
        "plain": rf"\s(?:{letter}|['’-])++[.,;:!?]?(?!\S)", "capitals": rf"\s{upper}{{2,}}+[.,;:!?]*+(?!\S)", "capitalized": rf"\s{upper}", "signs": r"[#$%&*|<>{}~^_=+\\@]++",
        "numbers": r"[0-9]++", "letters": rf"\s{letter}(?!\S)", "again": r"\s(\S++)(?=\s++\1(?!\S))", "blanks": r"\s++",
    }
    out |= {k: share(re.sub(p, "", t)) for k, p in plain.items()}
    return out | {k: share(t.replace(c, "")) for k, c in rules.SINGLE.items()}


TEXTS = ["Hello there, my friend.", "BUY NOW!! NOW NOW", "a | b | c 123", "", None, "one one one two\nÉté är it's", "x" * 3000 + " $$$", "word " * 20_000]


def test_statistics_equal_those_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in rules.statistics(docs, "t").collect():
        want = by_hand(TEXTS[r["i"]])
        assert set(want) == set(rules.STATISTICS)
        assert all(abs(r[k] - v) < 1e-12 for k, v in want.items()), (r, want)


def test_rules_are_the_paths_of_printed_trees():
    text = """RandomForestClassificationModel: numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 0.25)
      Predict: 0.0
     Else (feature 1 > 0.25)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 3.0)
      Predict: 1.0
     Else (feature 0 > 3.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    a, b = rules.STATISTICS[:2]
    want = [{(a, False, 1.5)}, {(a, False, 1.5), (b, False, 0.25)}, {(a, False, 1.5), (b, True, 0.25)}, {(a, True, 1.5)}, {(a, True, 1.5), (a, False, 3.0)}, {(a, True, 3.0)}]
    assert rules.tree_rules(text) == {rules.Rule(frozenset(w)) for w in want}


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op12_quality_rules"](spark, DATA).toPandas()


def test_held_out_accuracy(spark, scored):
    pdf = scored.merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    test = pdf[pdf["held_out"]]
    assert len(scored) == spark.read.parquet(f"{DATA}/documents.parquet").count() and scored["score"].between(0, 1).all()
    assert (test["predicted"] == test["quality"]).mean() > 0.95
    assert (test[test["quality"] == 1]["predicted"] == 1).mean() > 0.98 and (test[test["quality"] == 0]["predicted"] == 0).mean() > 0.85


def test_scores_are_the_weighted_rules(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = rules.train_rules(docs, labels)
    assert 3 <= len(model.rules) <= 80 and all(w for _, w in model.rules)
    for r in rules.quality(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(60).collect():
        s = by_hand(r["text"])
        z = model.bias + sum(w for rule, w in model.rules if all(s[k] > t if above else s[k] <= t for k, above, t in rule.conditions))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    again = rules.train_rules(docs.repartition(5), labels.repartition(3))
    assert str(again) == str(model)  # however the rows are dealt


def test_odd_rows_labels_and_tables(spark):
    docs = spark.createDataFrame([(1, "fine text, really.", 0.1, "x"), (1, "fine text, really.", 0.1, "x"), (None, None, 0.1, "x"), (2, "", None, None)], "doc_id long, text string, score double, again string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = rules.train_rules(docs, none)
    assert [r["score"] for r in rules.quality(docs, model).collect()] == [0.5] * 4 and rules.quality(docs, model).columns == ["doc_id", "score"]
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], none.schema)
    assert all(r["score"] > 0.9 for r in rules.quality(docs, rules.train_rules(docs, one)).collect())
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], none.schema)
    assert rules.quality(docs, rules.train_rules(docs, both)).where(F.col("score").between(0, 1)).count() == 4
    assert rules.quality(docs.limit(0), model).isEmpty()
