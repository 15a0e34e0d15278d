"""Importance resampling towards a target corpus, over inverted postings partitioned by bucket.

Features are runs of 1 to 3 words, hashed into buckets. Blocks of documents invert their counts into postings (bucket, document, count), packed by
range of buckets, and these are shuffled to their range; a range's rows are dealt to several partitions, so that no bucket, however common,
comes to one task. Both corpora's counts meet at their bucket, which gives its gain; each posting contributes count x gain, and a document's contributions are
summed where its block meets again. Gumbel noise from a seeded hash of the id turns weights into a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import pack, pack_keys, unpack, unpack_keys
from .scratch import drop, stored
from .words import ALNUM, lowered, pieces, text_bytes, word_bounds

#: Bytes of text that make a block, words that are looked at together, documents of a block at most, ranges of buckets.
BLOCK_BYTES, BLOCK_WORDS, BLOCK_DOCS, RANGES = 2 << 20, 1 << 20, 1 << 14, 50

_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_TABLE = _crc_table()


def _zeros_appended(width: int = 64) -> np.ndarray:
    """``[n, j, b]``: byte j of value b in a CRC register after n more zero bytes; shifts of whole registers are XORs of four look-ups."""
    out = np.empty((width, 4, 256), dtype=np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(1, width):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _TABLE[out[n - 1] & np.uint32(0xFF)]
    return out


_SHIFTS = _zeros_appended()


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after ``by`` zero bytes each."""
    crc, left = crc.copy(), by.copy()
    live = np.arange(len(crc))
    while len(live):
        n = np.minimum(left[live], len(_SHIFTS) - 1)
        c = crc[live]
        crc[live] = _SHIFTS[n, 0, c & 0xFF] ^ _SHIFTS[n, 1, (c >> 8) & 0xFF] ^ _SHIFTS[n, 2, (c >> 16) & 0xFF] ^ _SHIFTS[n, 3, c >> 24]
        left[live] -= n
        live = live[left[live] > 0]
    return crc


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of lower-cased ``data``, all words a byte at a time."""
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")  # the long ones first, so those still live are a prefix
    at, c = starts[order], crc
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for k, n in enumerate(live.tolist()):
        c[:n] = (c[:n] >> np.uint32(8)) ^ _TABLE[(c[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)]
    out = np.empty_like(c)
    out[order] = ~c
    return out


def run_crcs(crc: np.ndarray, size: np.ndarray, own: np.ndarray, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``longest`` words of one text (``own``), joined by one blank: where they begin and the CRC-32 of their bytes."""
    yield np.arange(len(crc)), crc
    # crc(a + b) is crc(a) moved on by b's length, XOR crc(b); a blank before each word makes b.
    blank = np.uint32(int(_TABLE[(0xFFFFFFFF ^ 0x20) & 0xFF]) ^ 0x00FFFFFF) ^ np.uint32(0xFFFFFFFF)
    tail = _shifted(np.full(len(crc), blank, np.uint32), size) ^ crc
    run = crc
    for n in range(1, longest):
        m = len(crc) - n
        if m <= 0:
            return
        run = _shifted(run[:m], size[n:] + 1) ^ tail[n:]
        keep = np.flatnonzero(own[:m] == own[n:])
        yield keep, run[keep]


def _features(column: pa.Array, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and buckets of all features of a batch of texts, some words at a time, and at last the words of each text (with None)."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at, ALNUM)
    low = lowered(data)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(column)), n_words)
    for lo in range(0, len(starts), BLOCK_WORDS):
        hi = min(len(starts), lo + BLOCK_WORDS + longest - 1)  # runs that begin here may end in the next words
        crc, size = word_crcs(low, starts[lo:hi], ends[lo:hi]), ends[lo:hi] - starts[lo:hi]
        for where, found in run_crcs(crc, size, text[lo:hi], longest):
            own = where < BLOCK_WORDS
            yield text[lo + where[own]], (found[own] % np.uint32(buckets)).astype(np.int64)
    yield n_words, None


def _width(buckets: int) -> int:
    return -(-buckets // RANGES)


_POSTINGS = "range int, salt int, block string, target boolean, docs int, keys binary, counts binary, ids array<{id}>, n_words array<long>"


def _inverter(kind: pa.DataType, buckets: int, longest: int):
    """Postings of each block by range, and a row of range -1 with the block's ids and words."""

    def row(**values) -> dict:
        return {"range": -1, "salt": 0, "block": None, "target": False, "docs": 0, "keys": None, "counts": None, "ids": None, "n_words": None} | values

    types = {"range": pa.int32(), "salt": pa.int32(), "block": pa.string(), "target": pa.bool_(), "docs": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "ids": pa.list_(kind), "n_words": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for whole in pieces(batches, "text", BLOCK_BYTES):
            for lo in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(lo, BLOCK_DOCS)
                made += 1
                block = f"{TaskContext.get().partitionId()}-{made}"
                target = batch.column(2)[0].as_py()
                docs, rows = batch.num_rows, []
                parts: list[tuple[np.ndarray, np.ndarray]] = []
                waiting, n_words = 0, np.zeros(docs, np.int64)
                for text, found in _features(batch.column(1), buckets, longest):
                    if found is None:
                        n_words = text
                        continue
                    parts.append(np.unique(found * docs + text, return_counts=True))
                    waiting += len(parts[-1][0])
                    if waiting > 4 * BLOCK_WORDS:
                        parts, waiting = [_summed(parts)], 0
                if parts:
                    keys, counts = _summed(parts)
                    of = keys // (docs * _width(buckets))
                    heads = np.flatnonzero(np.diff(of, prepend=-1))
                    for a, b in zip(heads.tolist(), np.append(heads[1:], len(keys)).tolist()):
                        r = int(of[a])
                        rows.append(row(range=r, salt=made, block=block, target=target, docs=docs, keys=pack_keys(keys[a:b] - r * docs * _width(buckets)), counts=pack(counts[a:b] - 1)))
                if not target:
                    rows.append(row(block=block, salt=made, docs=docs, ids=batch.column(0).to_pylist(), n_words=n_words.tolist()))
                if rows:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys together, in the keys' order."""
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _totals(buckets: int):
    """Sums of the postings by bucket and corpus, of each task's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _width(buckets) * RANGES), np.int64)
        for batch in batches:
            for r, target, docs, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                np.add.at(sums[int(target)], r * _width(buckets) + unpack_keys(keys) // docs, unpack(counts) + 1)
        live = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(live, pa.int64()), "s": pa.array(sums[0, live]), "t": pa.array(sums[1, live])})

    return run


def _contributions(buckets: int):
    """What each range of buckets adds to each document of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, blocks = [], []
            for block, docs, keys, counts, gains in zip(*(batch.column(i).to_pylist() for i in range(5))):
                k, by = unpack_keys(keys), np.zeros(_width(buckets), np.int64)
                by[[g["at"] for g in gains]] = [g["gain"] for g in gains]
                add = np.zeros(docs, np.int64)
                np.add.at(add, k % docs, by[k // docs] * (unpack(counts) + 1))
                blocks.append(block)
                out.append(pack((add << 1) ^ (add >> 63)))  # the sign last
            yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.string()), "adds": pa.array(out, pa.binary())})

    return run


def _reducer(kind: pa.DataType, longest: int):
    def reduce(heads: pa.Table, adds: pa.Table) -> pa.Table:
        """One block: its documents' contributions summed."""
        ids = heads.column("ids").combine_chunks().flatten() if heads.num_rows else pa.array([], kind)
        n = np.array(heads.column("n_words").combine_chunks().flatten().to_pylist() if heads.num_rows else [], np.int64)
        weight = np.zeros(len(n), np.int64)
        for raw in adds.column("adds").to_pylist():
            v = unpack(raw)
            weight += (v >> 1) ^ -(v & 1)
        features = sum((np.maximum(n - k, 0) for k in range(longest)), np.zeros(len(n), np.int64))
        block = heads.column("block").to_pylist()[:1] * len(n)
        return pa.table({
            "id": ids.cast(kind), "n_words": pa.array(n), "n_features": pa.array(features), "weight": pa.array(weight), "block": pa.array(block, pa.string()),
            "place": pa.array(np.arange(len(n)), pa.int64()),
        })

    return reduce


def bucket_gains(postings: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``gain`` of all ``buckets``, those without postings included: floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets))))."""
    sums = (
        postings.where("range >= 0").select("range", "target", "docs", "keys", "counts").mapInArrow(_totals(buckets), "bucket long, s long, t long")
        .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    )
    spark = postings.sparkSession
    sums = stored(sums, "bucket-sums")  # a row a bucket
    all_ = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    d = lambda c: c.cast("double")
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    ratio = d(t + 1) * d(F.lit(all_["s"] + buckets)) / (d(s + 1) * d(F.lit(all_["t"] + buckets)))
    return spark.range(buckets).withColumnRenamed("id", "bucket").join(sums, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def importance_weights(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, longest: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_features, weight (the sum of its features' gains), and block and place, which tell equal rows apart.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. NULL and empty texts have no features and weight 0; rows that repeat, and NULL
    ids, have a row each. An empty target makes every gain that of unseen buckets; an empty table has no rows. Texts of any length are read some words at a time.
    Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("target"))
    none = F.lit(None).cast(docs.schema[id_col].dataType).alias("id")
    goal = target.select(none, F.col(text_col).alias("text"), F.lit(True).alias("target"))
    kind, arrow = docs.schema[id_col].dataType.simpleString(), _arrow_type(docs, id_col)
    schema = _POSTINGS.format(id=kind)
    made = [t.mapInArrow(_inverter(arrow, buckets, longest), schema) for t in (own, goal)]
    # Partitions of different tables repeat their numbers, so a block is named by its corpus, too; only documents' blocks are met again.
    whole = made[0].unionByName(made[1])
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("block", "salt"), F.lit(max(1, -(-4 * parts // RANGES)))).cast("int"))
    postings = stored(salted.repartition(parts, "range", "salt"), "postings")
    gains = stored(bucket_gains(postings, buckets), "gains")
    width = _width(buckets)
    by_range = gains.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.collect_list(F.struct((F.col("bucket") % width).alias("at"), "gain")).alias("gains"))
    # Buckets are a parameter, so their gains are a bounded table: each range's are sent to all its postings.
    held = postings.where("range >= 0 and not target").select("range", "block", "docs", "keys", "counts").join(F.broadcast(by_range), "range").select("block", "docs", "keys", "counts", "gains")
    adds = held.mapInArrow(_contributions(buckets), "block string, adds binary")
    heads = postings.where("range = -1").select("block", "ids", "n_words")
    out = heads.groupBy("block").cogroup(adds.groupBy("block")).applyInArrow(_reducer(arrow, longest), f"id {kind}, n_words long, n_features long, weight long, block string, place long")
    result = stored(out, "weights")
    drop(postings, gains)
    return result.withColumnRenamed("id", id_col)


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def gumbel(seed: int, id_: Column) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) from SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score and rank: of the N rows with ``least_words`` words or more the floor(percent N / 100) highest
    scores are drawn, ties to the smaller id (NULL last), and numbered from 1; others have NULL. Other cases as in :func:`importance_weights`."""
    rows = importance_weights(docs, target, buckets=buckets, longest=longest, id_col=id_col, text_col=text_col)
    scored = rows.withColumn("score", F.col("weight") + gumbel(seed, F.col(id_col)))
    # All rows in order over partitions: a row's number is its place in its partition after the rows of those before.
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("block"), F.col("place")]
    able = scored.where(F.col("n_words") >= least_words)
    placed = stored(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).select("block", "place", "_at"), "placed")
    parts = placed.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()  # a row a partition
    before, n = [], 0
    for r in parts:
        before.append((r["part"], n))
        n += r["count"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(before, "part long, start long")
    drawn = placed.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("part")).select("block", "place", (F.col("start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))
    drawn = drawn.where(F.col("rank") <= percent * n // 100)
    return scored.join(drawn, ["block", "place"], "left").select(id_col, "n_features", "weight", "score", "rank")
