"""Token ids in a content-addressed store of chunks with document recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SPACES, lowered, pieces, same_words, text_bytes, word_bounds, word_hashes

PIECE_BYTES = 2 << 20
#: A chunk ends where the rolling hash of the last WINDOW ids has its top bits zero (one id in 2**CUT_BITS), or at MOST ids.
WINDOW, CUT_BITS, MOST = 16, 9, 8192
_GEAR = np.random.default_rng(8).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunk_ends(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of several texts' ids, one after another. A cut depends on the ids before it in its text only, so equal passages
    are cut alike; every text ends a chunk."""
    text_ends = np.cumsum(counts)
    sums = np.cumsum(_GEAR[ids & 0xFFFF])
    rolling = sums.copy()
    rolling[WINDOW:] -= sums[:-WINDOW]
    cut = (rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS) == 0
    head = np.flatnonzero(cut)
    head = head[head - (text_ends - counts)[np.searchsorted(text_ends, head, "right")] >= WINDOW - 1]
    ends = np.union1d(head + 1, text_ends)
    starts = np.concatenate(([0], ends[:-1]))
    if len(ends) and (ends - starts).max() > MOST:
        ends = np.concatenate([np.append(np.arange(s + MOST, e, MOST), e) for s, e in zip(starts.tolist(), ends.tolist())])
    return ends


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """A worker's one encoder, whose remembered words serve all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Whole texts to ids through a tokenizer of the ``tokenizers`` library that lower-cases, drops white space and splits letters from signs.

    For such a tokenizer the ids of a text are those of its parts between ASCII white space in turn, whatever else they hold; a single comma or
    full stop after a Latin letter at the end of a part is a part of its own. Each distinct part is encoded once, and ids are
    gathered by part. Parts are found by 64-bit hashes and confirmed byte for byte, A-Z lower-cased; one that only shares another's hash
    is encoded by itself, as is one with an added token (``<|endoftext|>``, in whatever case). ``most`` bounds the parts remembered between batches.
    """

    def __init__(self, path: str, most: int = 600_000, joined: int = 64) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.joined = most, joined
        self.added = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        #: Tokens that end a word. A word of letters is one pre-token, so it has one of these, as its last.
        self.ends = np.zeros(1 << 17, dtype=bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        #: The parts' bytes one after another, and where each ends.
        self.bytes, self.stops = np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by ``end_id``, and how many each text has with it."""
        if len(self.known) > self.most:
            self._clear()
        data, at = text_bytes(column)
        starts, ends, first = _parts(data, at)
        hashes, once, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[k] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            self._learn(hashes[new], self._words(data, starts[once[new]], ends[once[new]]))
            k = np.searchsorted(self.known, hashes)
        which = self.place[k][back]
        flat, sizes = self.flat, self.sizes
        sure = same_words(data, starts, ends, self.bytes, np.concatenate(([0], self.stops))[which], self.stops[which])
        sure[self._holding_added(data, starts)] = False
        if not sure.all():
            odd = np.flatnonzero(~sure)
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts[odd].tolist(), ends[odd].tolist())]
            own = {w: i for i, w in enumerate(dict.fromkeys(words))}
            apart = self._ids([w.decode() for w in own])
            which[odd] = len(sizes) + np.array([own[w] for w in words])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(apart), np.uint32)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, apart), np.int64, len(apart))])
        n = sizes[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], n) + np.arange(upto[-1])]
        stops = upto[first[1:]]
        return np.insert(ids, stops, np.uint32(end_id)), np.diff(np.concatenate(([0], stops))) + 1

    def _holding_added(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The parts that hold an added token in any case. These tokens are found before lower-casing, so such parts are encoded as they stand."""
        low, found = lowered(data).tobytes(), []
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                found.append(at)
                at = low.find(token, at + 1)
        return np.searchsorted(starts, np.array(found, np.int64), "right") - 1

    @staticmethod
    def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        low = lowered(data).tobytes()
        return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        words = [w.decode() for w in parts]
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        other = [i for i, w in enumerate(words) if not w.isalpha()]
        order, flat, sizes = [], [], []
        groups = [plain[i : i + self.joined] for i in range(0, len(plain), self.joined)]
        for group, found in zip(groups, self._ids([" ".join(words[i] for i in g) for g in groups])):
            ids = np.array(found, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                order += group
                flat.append(ids)
                sizes.append(np.diff(stops, prepend=0))
            else:  # lower-casing has made signs of a letter
                other += group
        order += other
        apart = self._ids([words[i] for i in other])
        flat.append(np.fromiter(chain.from_iterable(apart), np.uint32))
        sizes.append(np.fromiter(map(len, apart), np.int64, len(apart)))
        at = len(self.sizes)
        self.flat = np.concatenate([self.flat, *flat])
        self.sizes = np.concatenate([self.sizes, *sizes])
        learned = [parts[i] for i in order]
        last = self.stops[-1] if len(self.stops) else 0
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(learned), np.uint8)])
        self.stops = np.concatenate([self.stops, last + np.cumsum(np.fromiter(map(len, learned), np.int64, len(learned)))])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(at, at + len(order))
        spots = np.searchsorted(self.known, hashes)  # both are in order
        self.known, self.place = np.insert(self.known, spots, hashes), np.insert(self.place, spots, place)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])  # after 0xC3


def _parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts, and each text's first (and the end)."""
    starts, ends, first = word_bounds(data, at, ~SPACES)
    if not len(starts):
        return starts, ends, first
    size = ends - starts
    before = data[np.maximum(ends - 2, 0)]
    letter = _LETTER[before] | (_LATIN[before] & (data[np.maximum(ends - 3, 0)] == 0xC3) & (size > 2))
    stop = (size > 1) & letter & np.isin(data[ends - 1], [0x2C, 0x2E])
    own = np.repeat(np.arange(len(starts)), 1 + stop)
    second = np.zeros(len(own), dtype=bool)
    second[1:] = own[1:] == own[:-1]
    lo = np.where(second, ends[own] - 1, starts[own])
    hi = np.where(stop[own] & ~second, ends[own] - 1, ends[own])
    return lo, hi, first + np.concatenate(([0], np.cumsum(stop)))[first]


def _encoder(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        sent: set[bytes] = set()
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, counts = encoder.encode(batch.column(1), end_id)
            ends = chunk_ends(ids, counts)
            starts = np.concatenate(([0], ends[:-1]))
            raw, short = ids.astype("<u4").tobytes(), ids.astype("<u2").tobytes()
            narrow = np.maximum.reduceat(ids, starts) < 1 << 16
            digests = [hashlib.blake2b(raw[4 * s : 4 * e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())]
            fresh = []
            for i, digest in enumerate(digests):
                if digest not in sent:
                    sent.add(digest)
                    fresh.append(i)
            if len(sent) > 200_000:  # a chunk sent twice only costs a row: duplicates go after the shuffle
                sent.clear()
            lo, hi = starts[fresh].tolist(), ends[fresh].tolist()
            packed = [short[2 * s : 2 * e] if w else raw[4 * s : 4 * e] for s, e, w in zip(lo, hi, narrow[fresh].tolist())]
            yield _rows("chunk", [None] * len(fresh), [e - s for s, e in zip(lo, hi)], [digests[i] for i in fresh], packed, [None] * len(fresh))
            upto = np.searchsorted(ends, np.cumsum(counts), "left") + 1
            recipes = [digests[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]
            roots = [recipe_root(r) for r in recipes]
            yield _rows("recipe", batch.column(0), counts, roots, [None] * len(roots), recipes)

    return encode


def _rows(kind: str, doc_id, n, digest: list, ids: list, recipe: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(doc_id, pa.int64()), "kind": pa.array([kind] * len(digest), pa.string()), "n": pa.array(n, pa.int64()),
        "digest": pa.array(digest, pa.binary()), "ids": pa.array(ids, pa.binary()), "recipe": pa.array(recipe, pa.list_(pa.binary())),
    })


_ROW = "doc_id long, kind string, n long, digest binary, ids binary, recipe array<binary>"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, each chunk once, and every recipe."""
    last = None
    for batch in batches:
        keep = []
        for kind, digest in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            keep.append(kind == "recipe" or digest != last)
            if kind == "chunk":
                last = digest
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts and write the store below ``folder``.

    ``chunks``: digest, n, ids (little-endian; 2 bytes an id where all fit, else 4): each distinct chunk once.
    ``recipes``: doc_id, start (ids of all documents before), n_tokens, chunks (digests in order), root: in
    files of ascending doc_id. ``manifest``: for each recipe file's range of rows its number, first id, rows, tokens and the Merkle
    root over its recipes' roots, from which the root of the whole follows.

    Texts are encoded where they are read; only new chunks are shuffled, by digest. NULL text counts as empty (its ids: the
    end id alone); NULL ids come first; rows that repeat an id are each encoded, in the order of their digests. Ids are whole numbers; what cannot be cast to
    one raises. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _encoder(tokenizer, end_id), _ROW
    )
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id"))
    (
        rows.withColumn("spread", spread).repartition(parts, "spread").sortWithinPartitions("kind", "digest").drop("spread")
        .mapInArrow(_once, _ROW)
        .write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/raw")
    )
    recipes = spark.read.schema(_ROW).parquet(f"{folder}/raw").where("kind = 'recipe'")
    ordered = (
        recipes.select("doc_id", F.col("n").alias("n_tokens"), F.col("recipe").alias("chunks"), F.col("digest").alias("root"))
        .repartitionByRange(parts, "doc_id", "root")
        .sortWithinPartitions("doc_id", "root")
        .withColumn("part", F.spark_partition_id())
    )
    ordered.write.partitionBy("part").parquet(f"{folder}/ordered")
    ordered = spark.read.schema(ordered.schema).parquet(f"{folder}/ordered")
    # One row for each range of documents: their number follows the shuffle partitions.
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).selectExpr(
        "part", "sum(tokens) over (order by part) - tokens as before"
    )
    own = "part order by doc_id nulls first, root rows between unbounded preceding and current row"
    placed = (
        ordered.join(F.broadcast(sums), "part")
        .withColumn("start", F.expr(f"before + sum(n_tokens) over (partition by {own}) - n_tokens"))
        .select("part", "doc_id", "start", "n_tokens", "chunks", "root")
    )
    placed.write.partitionBy("part").parquet(f"{folder}/recipes")
    _roots(spark, folder).write.parquet(f"{folder}/manifest")


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd leaf rises as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        pairs = [hashlib.blake2b(level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _roots(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each part of the recipes as they now are: its Merkle root, whose leaves are hashed from the recipes' chunks."""
    rows = read_recipes(spark, folder).select("part", "start", "n_tokens", "chunks").repartition("part").sortWithinPartitions("part", "start")
    return rows.mapInArrow(_manifest, "part int, first_start long, n_docs long, n_tokens long, root binary")


def recipe_root(chunks: list[bytes]) -> bytes:
    """The hash of a document's chunk digests in order."""
    return hashlib.blake2b(b"".join(chunks), digest_size=16).digest()


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part, from rows sorted by (part, start)."""
    parts: dict[int, list] = {}
    for batch in batches:
        for part, start, n, chunks in zip(*(c.to_pylist() for c in batch.columns)):
            held = parts.setdefault(part, [start, 0, 0, []])
            held[1] += 1
            held[2] += n
            held[3].append(recipe_root(chunks))
    cols = list(zip(*((p, s, d, n, merkle_root(r)) for p, (s, d, n, r) in sorted(parts.items())))) or [()] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
        names=["part", "first_start", "n_docs", "n_tokens", "root"],
    )


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, chunks array<binary>, root binary, part int"
    return spark.read.schema(schema).parquet(f"{folder}/recipes")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(f"{folder}/raw").where("kind = 'chunk'").select("digest", "n", "ids")


def _unpacked(ids: bytes, n: int) -> bytes:
    """Little-endian 32-bit ids, whichever width they are kept in."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC of each chunk read from the store, whose ids must give its digest."""
    import zlib

    for batch in batches:
        crcs = []
        for digest, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            raw = _unpacked(ids, n)
            if hashlib.blake2b(raw, digest_size=16).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its digest")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_pydict({"digest": batch.column(0), "n": batch.column(1), "crc": pa.array(crcs, pa.int64())})


def crc_shift(size: int) -> np.ndarray:
    """The 32 columns of the matrix that moves a CRC-32 over ``size`` zero bytes (GF(2), reflected polynomial)."""
    poly = 0xEDB88320

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if b >> k & 1:
                out ^= a
            a = (a >> 1) ^ (poly if a & 1 else 0)
        return out

    power, square, bits = 0x80000000, 0x00800000, size  # 1, x**8
    while bits:
        if bits & 1:
            power = times(power, square)
        square = times(square, square)
        bits >>= 1
    return np.array([times(1 << k, power) for k in range(32)], dtype=np.uint32)


def _document_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC of whole documents from their chunks' CRCs and lengths: crc(ab) = shift(crc(a), len b) ^ crc(b)."""
    shifts: dict[int, np.ndarray] = {}
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("parts"))
        inner = lists.flatten()
        crc = inner.field("crc").to_numpy(zero_copy_only=False).astype(np.uint32)
        n = inner.field("n").to_numpy(zero_copy_only=False)
        sizes, which = np.unique(n, return_inverse=True)
        for s in sizes.tolist():
            if s not in shifts:
                shifts[s] = crc_shift(4 * s)
        table = np.array([shifts[s] for s in sizes.tolist()], dtype=np.uint32).reshape(-1, 32)
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        count = np.diff(at)
        total = np.zeros(len(count), dtype=np.uint32)
        live = np.flatnonzero(count)
        k = 0
        while len(live):
            part = at[live] + k
            moved = np.zeros(len(live), dtype=np.uint32)
            for bit in range(32):
                moved ^= np.where(total[live] >> np.uint32(bit) & np.uint32(1), table[which[part], bit], np.uint32(0))
            total[live] = moved ^ crc[part]
            k += 1
            live = live[count[live] > k]
        seen = np.array([x[-1] - x[0] for x in zip(at[:-1], at[1:])])
        tokens = np.add.reduceat(np.append(n, 0), np.minimum(at[:-1], len(n))) if len(n) else np.zeros(len(count), np.int64)
        tokens[seen == 0] = 0
        wanted = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
        if not np.array_equal(tokens, wanted):
            raise ValueError("a recipe's chunks do not add up to its document")
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(batch.schema.get_field_index("doc_id")), "start": batch.column(batch.schema.get_field_index("start")),
            "n_tokens": pa.array(tokens, pa.int64()), "ids_crc32": pa.array(total.astype(np.int64), pa.int64()),
        })


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    Every chunk is read, unpacked and held against its digest once; only CRCs and lengths, not ids, are
    then joined to the recipes, and a document's CRC follows from those of its chunks in order. A missing chunk raises, and so do
    recipes that no longer give the Merkle roots of the manifest (a changed, moved, added or lost chunk or document).
    """
    if broken := verify_manifest(spark, folder).where("not intact").orderBy("part").limit(1).collect():
        raise ValueError(f"the recipes of part {broken[0]['part']} do not give the manifest's Merkle root")
    chunks = read_chunks(spark, folder).mapInArrow(_checked, "digest binary, n long, crc long")
    entries = read_recipes(spark, folder).select("doc_id", "start", "n_tokens", F.posexplode("chunks").alias("pos", "digest"))
    joined = entries.join(chunks, "digest", "left").withColumn(
        "n", F.coalesce("n", F.raise_error(F.lit("a recipe names a chunk that the store lacks")).cast("long"))
    )
    whole = joined.groupBy("start", "doc_id", "n_tokens").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))), lambda p: F.struct(p["n"].alias("n"), p["crc"].alias("crc"))).alias("parts")
    )
    return whole.mapInArrow(_document_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, intact): whether each part's recipes, hashed again from their chunks, give the Merkle root, documents and ids in its manifest."""
    kept = spark.read.schema("part int, first_start long, n_docs long, n_tokens long, root binary").parquet(f"{folder}/manifest")
    now = _roots(spark, folder).select("part", *[F.col(c).alias(f"{c}_now") for c in ("first_start", "n_docs", "n_tokens", "root")])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_now")) for c in ("first_start", "n_docs", "n_tokens", "root")]
    return kept.join(now, "part", "full").select("part", (same[0] & same[1] & same[2] & same[3]).alias("intact"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): whole documents put together again from recipes and chunks."""
    entries = read_recipes(spark, folder).select("doc_id", "start", F.posexplode("chunks").alias("pos", "digest"))

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(_unpacked(c["ids"], c["n"]) for c in x), "<u4").astype(np.int64).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "start": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int64()))})

    whole = entries.join(read_chunks(spark, folder), "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "ids"))).alias("parts"))
    return whole.mapInArrow(glue, "doc_id long, start long, ids array<long>")
