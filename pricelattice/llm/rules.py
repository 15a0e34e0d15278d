"""Text quality by a sparse ensemble of rules over statistics.

A forest of shallow trees over statistics of labelled texts proposes conjunctions (every path from a root), a lasso logistic fit keeps few of them
with weights, and those compile into one Spark column: scoring a corpus is a projection of built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from math import log
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored

#: Shares of a text's characters: those that a pattern covers (a blank stands before the text), and single signs.
COVERED = {
    "plain": r"\s[\p{L}'’-]++[.,;:!?]?(?!\S)",
    "capitals": r"\s\p{Lu}{2,}+[.,;:!?]*+(?!\S)",
    "capitalized": r"\s\p{Lu}",
    "signs": r"[#$%&*|<>{}~^_=+\\@]++",
    "numbers": r"\d++",
    "letters": r"\s\p{L}(?!\S)",
    "again": r"\s(\S++)(?=\s++\1(?!\S))",
    "blanks": r"\s++",
}
SINGLE = {"stops": ".", "commas": ",", "shouts": "!", "lines": "\n"}
STATISTICS = ("length", *COVERED, *SINGLE)

Condition = tuple[str, bool, float]  # statistic, above (else at most), threshold


def statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``text`` replaced by columns named as ``STATISTICS``: the logarithm of the text's length, and shares of its characters. NULL and
    empty texts have zeros."""
    t = F.col(text)
    n = F.length(t)
    share = lambda rest: F.when(n > 1, (n - F.length(rest)) / n).otherwise(F.lit(0.0))
    covered = [share(F.regexp_replace(t, p, "")).alias(k) for k, p in COVERED.items()]
    single = [share(F.replace(t, F.lit(c), F.lit(""))).alias(k) for k, c in SINGLE.items()]
    spaced = rows.withColumn(text, F.concat(F.lit(" "), F.coalesce(t, F.lit(""))))
    return spaced.select(*[c for c in rows.columns if c != text], F.log(n.cast("double")).alias("length"), *covered, *single)


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions on statistics."""

    conditions: frozenset[Condition]

    def column(self) -> Column:
        held = [F.col(k) > t if above else F.col(k) <= t for k, above, t in sorted(self.conditions)]
        return reduce(and_, held)

    def __str__(self) -> str:
        return " and ".join(f"{k} {'>' if above else '<='} {t:.4g}" for k, above, t in sorted(self.conditions))


@dataclass
class RuleModel:
    """Weighted rules; the score is the logistic function of their sum."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score, over columns named as ``STATISTICS``."""
        parts = [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules]
        return 1 / (1 + F.exp(-reduce(add, parts, F.lit(self.bias))))


_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(text: str) -> set[Rule]:
    """All paths from the roots of the trees that ``text`` prints (a model's ``toDebugString``); of conditions on one statistic the tightest counts."""
    rules, path = set(), []
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m:
            path = path if "Predict" in line else []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[3])], m[4] == ">", float(m[5])))]
        tight: dict[tuple[str, bool], float] = {}
        for _, (k, above, t) in path:
            tight[k, above] = (max if above else min)(tight.get((k, above), t), t)
        rules.add(Rule(frozenset((k, above, t) for (k, above), t in tight.items())))
    return rules


def train_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, trees: int = 20, depth: int = 3,
    lasso: float = 0.001, seed: int = 7,
) -> RuleModel:
    """Learn rules from labelled rows of ``labels`` (id, 0 or 1), the first ``max_rows`` of them by a hash of the id; their statistics, a few numbers
    each, are one partition, so that the fit does not depend on how the corpus is dealt.

    Rows with NULL id or label are not used; an id labelled twice has its larger label; rows of ``docs`` that repeat an id all carry its label. NULL and empty texts
    take part with zeros. Labels of one kind, or too few to split, give a constant score, no labels 0.5. Other columns are ignored, whatever their names.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_y", "_text")
    rows = stored(statistics(found, "_text").coalesce(1).sortWithinPartitions("_y", *STATISTICS), "labelled-statistics")
    n = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    constant = RuleModel(0.0 if not n else 5.0 if 0 not in n else -5.0 if 1 not in n else log(n[1] / n[0]))
    if len(n) < 2:
        drop(rows)
        return constant
    data = rows.select(F.col("_y").cast("double").alias("label"), array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS).coalesce(1)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed).fit(data)
    rules = sorted(tree_rules(forest.toDebugString), key=lambda r: sorted(r.conditions))
    if not rules:  # too few rows to split
        drop(rows)
        return constant
    held = data.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")).coalesce(1)
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=200).fit(held)
    drop(rows)
    return RuleModel(float(fit.intercept), [(r, float(w)) for r, w in zip(rules, fit.coefficients.toArray().tolist()) if w != 0.0])


def quality(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and score (0 to 1) of the whole text. NULL and empty texts have the score of zeros; rows that repeat are scored each; other columns
    are ignored, whatever their names."""
    stats = statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    return stats.select(F.col("_id").alias(id_col), model.column().alias("score"))
