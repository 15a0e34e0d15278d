"""URL filters: host-suffix and path-prefix expressions, joined to rules by short digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_filter(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Judge each row's URL by the longest rule that fits it.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). A rule fits its host and
    all subdomains, in whatever case of A-Z, where the URL's path starts with the rule's path. Of several, the longest
    ``host || path`` wins, then the longest host, then ``block``.

    Every distinct (host, path) is expanded into those suffix + prefix expressions that have the
    shape (labels in the host, characters in the path) of some rule, so a URL of a thousand labels
    costs no more than the rules' shapes. Expressions meet rules in an equi-join on the first 8 hex
    digits of their SHA-256; the full digests then confirm.

    Returns id, host, path, rule (NULL if none fits), verdict: a row for each input row, repeated rows
    and NULL ids included. NULL or malformed URLs have empty host and path and get ``default``.
    Other columns are ignored. The shapes, at most a few hundred pairs of small integers,
    are all that the driver sees.
    """
    r = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v")
    ).where("_h is not null and _h <> ''")
    r = r.select(
        F.concat("_h", "_p").alias("_rule"), "_v", F.size(F.split("_h", r"\.")).alias("_labels"),
        F.length("_h").alias("_hlen"), F.length("_p").alias("_plen"),
    )
    shapes = [(s["_labels"], s["_plen"]) for s in r.select("_labels", "_plen").distinct().collect()]
    r = r.withColumn("_digest", F.sha2("_rule", 256)).withColumn("_short", F.substring("_digest", 1, 8))

    judged = pages.select(
        F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path")
    )
    keys = judged.where("_host <> ''").select("_host", "_path").distinct()
    labels, chars = F.size(F.split("_host", r"\.")), F.length("_path")
    forms = [
        F.when(
            (labels >= n) & (chars >= c), F.concat(F.substring_index("_host", ".", -n), F.substring("_path", 1, c))
        )
        for n, c in sorted(shapes)
    ]
    expanded = keys.select("_host", "_path", F.explode(F.array_compact(F.array(*forms))).alias("_form")) if forms else (
        keys.select("_host", "_path", F.lit(None).cast("string").alias("_form")).limit(0)
    )
    expanded = expanded.withColumn("_full", F.sha2("_form", 256)).withColumn("_short", F.substring("_full", 1, 8))
    best = (
        expanded.join(r, "_short")
        .where("_full = _digest")
        .groupBy("_host", "_path")
        .agg(F.max(F.struct(F.col("_hlen") + F.col("_plen"), "_hlen", "_v", "_rule")).alias("_best"))
    )
    return judged.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best._rule").alias("rule"), F.coalesce("_best._v", F.lit(default)).alias("verdict"),
    )
