"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored


SHARD, SLOT = "_shard", "_slot"


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row; maps count by their JSON."""
    columns = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def shuffled_shards(
    docs: DataFrame, n_shards: int = 16, *, seed: int = 20, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` in one uniform random order, dealt to ``n_shards`` shards.

    Pass one scatters rows into buckets by a seeded hash of the whole row, so neither an id nor NULL ids fill a bucket; there are as many buckets
    as the text bytes need at ``bucket_bytes`` each. Equal rows that alone would take a quarter of a bucket are counted and sent out again as
    numbered copies, which scatter like other rows. Pass two puts each bucket, alone in memory, into order by (id, hashes of the row)
    and runs a seeded Fisher-Yates shuffle over it. Buckets follow one another, so a row's place in
    the whole is its bucket's offset plus its place inside; shard = place mod n_shards and slot = place div n_shards,
    so the law is ``rows``: shard sizes differ by one at most and slots have no gap.

    The order depends on the rows and the seed only, never on how they arrive, so a task that
    runs again after a lost executor gives the same rows. Adds ``_shard`` int and ``_slot`` long (columns of these names in ``docs`` are replaced; any
    other name may occur). NULL ids and texts take part as any other; repeated rows each keep a place of their own. An empty table gives an empty result.
    """
    return _shuffled(docs, n_shards, seed, bucket_bytes, id_col, text_col)[0]


def _shuffled(docs: DataFrame, n_shards: int, seed: int, bucket_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The rows of :func:`shuffled_shards`, a partition a bucket, and how many buckets there are."""
    docs = docs.drop(SHARD, SLOT)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    one, two = row_hashes(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), one.alias("h1"), two.alias("h2"))
    total = docs.agg(F.sum(size).alias("b")).first()["b"] or 0
    n_buckets = max(n_shards, -(-int(total) // bucket_bytes))
    many = docs.select(one.alias("h1"), two.alias("h2"), size.alias("s")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("s").alias("s"))
    many = stored(many.where((F.col("n") > 1) & (F.col("n") * F.col("s") > bucket_bytes // 4)).select("h1", "h2"), "many")
    copies = rows.join(many, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"), F.first("id").alias("id"), F.count("*").alias("n"))
    apart = rows.join(many, ["h1", "h2"], "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(
        copies.select("h1", "h2", "row", "id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    )
    dealt = apart.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "copy"), F.lit(n_buckets)).cast("int"))
    counts = stored(dealt.groupBy("bucket").agg(F.count("*").alias("count")), "buckets")
    # One row a bucket; the running sum is over buckets, of which there is one for some MB of text.
    offsets = counts.selectExpr("bucket", "sum(count) over (order by bucket) - count as offset")
    scattered = (
        dealt.join(offsets, "bucket").select("bucket", "offset", "id", "h1", "h2", "row")
        .repartition(min(n_buckets, 100_000), "bucket")
        .sortWithinPartitions("bucket", "id", "h1", "h2")
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(SHARD, T.IntegerType()), T.StructField(SLOT, T.LongType())])
    names = schema.fieldNames()

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            b = table.column("bucket")[0].as_py()
            order = shuffled(table.num_rows, seed, b)
            place = np.arange(table.num_rows) + table.column("offset")[0].as_py()
            for lo in range(0, table.num_rows, 2000):
                part = pa.array(order[lo : lo + 2000])
                rows = table.column("row").take(part).combine_chunks()
                at = place[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array((at % n_shards).astype(np.int32)), pa.array(at // n_shards)], names=names)

    return scattered.mapInArrow(shuffle, schema), n_buckets


def write_shards(
    docs: DataFrame, folder: str, n_shards: int = 16, *, seed: int = 20, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the shards of :func:`shuffled_shards` below ``folder``: a folder a shard, whose files hold rows in the order of their slots. A task writes four buckets'
    rows, so a file has a few MB where buckets have some ten for each shard; a task that runs again writes the same."""
    rows, buckets = _shuffled(docs, n_shards, seed, bucket_bytes, id_col, text_col)
    rows.coalesce(-(-min(buckets, 100_000) // 4)).sortWithinPartitions(SHARD, SLOT).write.partitionBy(SHARD).parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """What :func:`write_shards` has written, with ``_slot`` and ``_shard``; ``schema`` is that of the rows, for shards that may be empty."""
    if schema is None:
        return spark.read.parquet(folder)
    own = [f for f in schema.fields if f.name not in (SHARD, SLOT)]
    return spark.read.schema(T.StructType([*own, T.StructField(SLOT, T.LongType()), T.StructField(SHARD, T.IntegerType())])).parquet(folder)


def shuffled(n: int, seed: int, bucket: int) -> np.ndarray:
    """The numbers below ``n`` in the order that a Fisher-Yates shuffle under this seed gives a bucket."""
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one bucket each from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and held[0].column(held[0].schema.get_field_index("bucket"))[0].as_py() != b[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
