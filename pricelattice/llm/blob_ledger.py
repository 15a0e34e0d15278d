"""Secret scans over an incremental blob ledger, with Spark expressions only.

Every version of a text is a blob, named by its SHA-256. A ledger folder keeps which blob each path
held and what each rule version found in each blob; a run scans only the (blob, rule version)
pairs that the ledger has not seen, then joins findings to all paths of all versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) of which ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"


# The kinds of secrets, in the order in which they are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PATHS = T.StructType([T.StructField("path", T.LongType()), T.StructField("blob", T.StringType())])
_FOUND = T.StructType(
    [T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("version", T.StringType()), T.StructField("spans", SPANS)]
)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of a rule's matches in ``text``.

    The text between matches comes from a split by the same pattern, so that running lengths
    of gaps and matches give the places. Texts without a match are only searched once.
    A long run of one character class is one match at once; runs too short for a rule of a
    single class are skipped inside the pattern, which finds the same spans with short arrays.
    """
    p = F.lit(_tight(rule))
    hits = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, _tight(rule), -1)
    lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.coalesce(F.length(h), F.lit(0)).cast("long").alias("h"), h.alias("m")))
    none = F.array().cast(SPANS)
    long_enough = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["h"]
        keep = x["m"].isNotNull() & long_enough(x["m"])
        more = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(keep, more).otherwise(acc["spans"]).alias("spans"))

    # Appending copies an array, so matches are walked in runs of _RUN, each from the place that the one before has come to.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN)), lambda k: F.slice(lengths, (k * _RUN + 1).cast("int"), F.lit(_RUN)))
    place = lambda at: F.struct(at.alias("at"), none.alias("spans"))
    walked = F.aggregate(
        runs, F.array(place(F.lit(0).cast("long"))), lambda acc, run: F.concat(acc, F.array(F.aggregate(run, place(F.element_at(acc, -1)["at"]), step)))
    )
    return F.when(F.regexp_like(text, p), F.flatten(F.transform(walked, lambda w: w["spans"]))).otherwise(none)


#: Parts that the paths of one blob are dealt to.
_SALTS = 16
#: Matches that are walked together.
_RUN = 256


def _tight(rule: Rule) -> str:
    """For a pattern that ends in one greedy class and counts its whole match, the least length can go into
    the pattern: the first match in a maximal run is its longest, so if that is too short, all inside it are."""
    if rule.group == 0 and rule.pattern == r"AKIA[A-Z0-9]+":
        return r"AKIA[A-Z0-9]{%d,}" % (rule.least - 4)
    if rule.group == 0 and rule.pattern == r"[0-9a-f]+":
        return r"[0-9a-f]{%d,}" % rule.least
    return rule.pattern


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one where none has been written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_versions(
    docs: DataFrame, ledger: str, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scan what the ledger folder has not seen, add to it, and return (path, blob, kind, version, spans).

    A row for each path that the ledger holds, in any version that the path ever had, and each kind that this blob holds under these
    rules. Blobs without findings are in the ledger too (with an empty ``spans``), so that no later run scans them again, but are left
    out of the result. NULL text counts as empty; repeated rows count once; rows with
    a NULL id are scanned with the rest under the path NULL. Other columns are ignored.

    A blob's copies may be a third of all rows: the smallest path of each blob is found with
    map-side aggregation, and only that path's text goes to the scan. Findings are written before paths, so a run that dies
    leaves no path without its findings.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).cast("long").alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    held = f"{ledger}/paths"
    now = stored(versions.select("path", "blob").distinct(), "versions")

    first = now.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("n"), F.col("path"))).alias("p"))
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version string")
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = _table(spark, f"{ledger}/findings", _FOUND).select("blob", "kind", "version").distinct()
    unseen = (
        first.select("blob", "p", F.inline(each))
        .join(seen, ["blob", "kind", "version"], "left_anti")
        .groupBy("blob")
        .agg(F.first("p.path").alias("path"), F.collect_set("kind").alias("kinds"))
    )
    same = F.col("v.path").eqNullSafe(F.col("u.path")) & (F.col("v.blob") == F.col("u.blob"))
    todo = versions.alias("v").join(unseen.hint("shuffle_hash").alias("u"), same).select("v.blob", "v.text", "u.kinds")
    kinds = F.array(
        *[
            F.when(
                F.array_contains("kinds", r.kind),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), rule_spans(F.col("text"), r).alias("spans")),
            )
            for r in rules
        ]
    )
    found = todo.select("blob", F.explode(F.array_compact(kinds)).alias("f")).select("blob", "f.kind", "f.version", "f.spans")
    found.write.mode("append").parquet(f"{ledger}/findings")
    spark.catalog.refreshByPath(f"{ledger}/findings")
    now.subtract(_table(spark, held, _PATHS)).write.mode("append").parquet(held)
    drop(now)
    live = _table(spark, f"{ledger}/findings", _FOUND).where(F.size("spans") > 0).join(F.broadcast(wanted), ["kind", "version"])
    spark.catalog.refreshByPath(held)
    # A blob may have a third of all paths: paths meet findings under salts, which only blobs with findings are repeated for.
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    found = live.dropDuplicates(["blob", "kind", "version"]).select("blob", "kind", "version", "spans", salts)
    paths = _table(spark, held, _PATHS).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).cast("int"))
    return paths.join(found, ["blob", "salt"]).select("path", "blob", "kind", "version", "spans")


def span_digest(
    docs: DataFrame, findings: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``docs``: counts by kind and the spans as text, by start, then kind as listed.

    A row's findings are those of its path and its own blob, at most one for each kind, so texts that share an id (or have
    none) keep their own.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    per_version = (
        findings.withColumn("k", order[F.col("kind")])
        .groupBy("path", "blob")
        .agg(
            F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("k").alias("k"), s["end"].alias("end"), F.col("kind").alias("kind"))))).alias("s"),
            *[F.sum(F.when(F.col("kind") == r.kind, F.size("spans")).otherwise(0)).alias(f"n_{r.kind}") for r in rules],
        )
    )
    spans = F.coalesce(F.array_join(F.transform(F.sort_array("s"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))
    ids = docs.select(F.col(id_col).cast("long").alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_blob"))
    own = F.col("_id").eqNullSafe(F.col("path")) & (F.col("_blob") == F.col("blob"))
    return ids.join(per_version, own, "left").select(
        F.col("_id").alias(id_col),
        *[F.coalesce(F.col(f"n_{r.kind}"), F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )
