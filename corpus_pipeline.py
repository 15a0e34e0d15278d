"""The corpus pipeline: toxic documents go, near-duplicates and benchmark passages go, sources are mixed, ids are stored.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``. Classifiers, statistics and candidates are
fitted on what the stage before kept, with the labels of ``sf_dir``. SQL cannot express learned scores or
tokenizers, so there is no oracle; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.llm.lsh_forest import without_near_duplicates
from pricelattice.llm.mixing import fit_domains, fit_rates, memberships, mixed
from pricelattice.llm.queries import QUALITY_WEIGHTS
from pricelattice.llm.scratch import drop, shared_folder, stored
from pricelattice.llm.suffix_search import without_matches
from pricelattice.llm.token_store import read_documents, write_store
from pricelattice.llm.toxicity import held_out, train, without_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return without_toxic(docs, train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each component the row with the smallest id stays, once; rows are told apart by id and text. Links are at similarity 0.85, as in
    the operator's query."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents in which a window of ``benchmark`` occurs go."""
    return without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents are repeated by their rates, 1 at least, towards the target weights; none is dropped. Where the target is out
    of reach (a corpus without tokens of a domain), the nearest mixture is used and a warning says so."""
    model = fit_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_col="quality")
    members = stored(memberships(docs, model), "members")
    return mixed(docs, fit_rates(members, model, QUALITY_WEIGHTS, least=1.0, headroom=1.1, strict=False))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a row for each document read back from the store's files."""
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    write_store(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written to the shared folder for the next, and removed once that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            drop(docs)
        docs = made
    return docs
