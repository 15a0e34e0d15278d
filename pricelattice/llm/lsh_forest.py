"""Near-duplicates by an LSH forest over word shingles, with every link confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .scratch import drop, stored
from .words import SPACES, mix, pieces, text_bytes, word_bounds, word_hashes

PIECE_BYTES = 2 << 20
#: Trees of the forest, values of a tree's signature, and those that candidates share at least. A pair of similarity 0.85
#: shares 2 values of one tree with 0.7225, and misses all 10 trees with 3 in a million.
TREES, DEPTH, LEAST_DEPTH = 10, 8, 2
_VALUES = TREES * DEPTH
#: Rows of a region in which all are compared; larger regions are split at the next depth.
REGION = 1024
#: Rows on either side that each row is compared with wherever regions, batches and partitions are cut.
NEAR = 8
#: Rows that are looked at together; a region that goes on is carried over, its last ``REGION`` rows at least.
BUFFER = 20_000
#: Trees whose candidate links are confirmed one by one; all trees say which rows may belong together.
LINK_TREES = 3
#: Shingles in a block of a candidate class.
BLOCK_SHINGLES = 20_000


def least_agreeing(percent: int) -> int:
    """Of a sketch's 2-bit values two sets of this similarity agree in so many, less 5.5 standard deviations: below, a pair is no candidate
    (at the similarity itself, 2 pairs in ten million)."""
    p = (1 + 3 * percent / 100) / 4
    return int(_VALUES * p - 5.5 * (_VALUES * p * (1 - p)) ** 0.5)


_ROWS = np.random.default_rng(5).integers(0, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(16)]


def shingle_hashes(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of all texts (repeats included), and where each text's begin. A text of fewer than
    ``k`` words has its whole sequence as one shingle."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at, ~SPACES)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out_at = np.concatenate(([0], np.cumsum(count)))
    head = np.repeat(first[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    size = np.repeat(np.minimum(n, k), count)
    total = size.astype(np.uint64)
    for j in range(k):
        use = size > j
        w = words[np.minimum(head + j, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        total += np.where(use, w * _PLACES[j], np.uint64(0))
    return mix(total), out_at


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, values) minima under each hash function. All texts must have a shingle."""
    out = np.empty((len(at) - 1, _VALUES), dtype=np.uint64)
    for v, a in enumerate(_ROWS):
        x = h * a
        x ^= x >> np.uint64(32)
        out[:, v] = np.minimum.reduceat(x, at[:-1])
    return out


_SKETCH = "doc_id long, row binary, n_shingles long, digest binary, sketch binary, keys array<binary>"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """SHA-256 of id and text; NULLs have keys of their own."""
    text = F.when(F.col(text_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(text_col)))
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), text), 256))


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, shingles, digest of the whole set, 2 bits of every minimum, and each tree's signature as a sort key."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            h, at = shingle_hashes(batch.column(1))
            size, digest, bits, keys = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            some = np.flatnonzero(np.diff(at))
            if len(some):
                values = _signatures(h, np.append(at[some], at[-1]))
                two = ((values >> np.uint64(20)) & np.uint64(3)).astype(np.uint8)
                packed = (two[:, 0::4] | (two[:, 1::4] << 2) | (two[:, 2::4] << 4) | (two[:, 3::4] << 6)).astype(np.uint8)
                short = (values >> np.uint64(24)).astype(">u4").reshape(len(some), TREES, DEPTH)
                for i, d in enumerate(some.tolist()):
                    s = np.unique(h[at[d] : at[d + 1]])
                    size[d] = len(s)
                    digest[d] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    bits[d] = packed[i].tobytes()
                    keys[d] = [short[i, t].tobytes() for t in range(TREES)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "row": batch.column(2), "n_shingles": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()),
                "sketch": pa.array(bits, pa.binary()), "keys": pa.array(keys, pa.list_(pa.binary())),
            })

    return _keyed(docs, id_col, text_col).mapInArrow(sketch, _SKETCH)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))


def _runs(key: np.ndarray, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
    """Regions of rows ``lo:hi``, which share ``depth`` values: small enough to compare all, or as deep as signatures go (then in windows that
    overlap by half)."""
    if hi - lo <= NEAR + 1:
        return
    if hi - lo <= REGION or depth == DEPTH:
        for at in range(lo, max(lo + 1, hi - REGION // 2), REGION // 2):
            yield at, min(hi, at + REGION)
        return
    cuts = (lo + 1 + np.flatnonzero(key[lo + 1 : hi, depth] != key[lo : hi - 1, depth])).tolist()
    for a, b in zip([lo, *cuts], [*cuts, hi]):
        yield from _runs(key, a, b, depth + 1)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many 2-bit values agree between rows of packed sketches."""
    x = a ^ b
    return _VALUES - np.bitwise_count((x | (x >> 1)) & 0x55).sum(axis=-1, dtype=np.int32)


_TREE_ROW = "tree int, key binary, doc_id long, n_shingles long, sketch binary"
_CANDIDATE = f"a long, b long, {_TREE_ROW}"


def _candidates(percent: int):
    """From rows sorted by (tree, key): candidate links (a, b, tree), and the rows of the first and last region, whose region may go on in
    the partition before or after (a and b NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BUFFER:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _region_starts(table)
            if first:
                yield _border(table.slice(0, min(REGION, int(np.append(starts, table.num_rows)[1]))))
                first = False
            yield _region_links(table, percent)
            held = table.slice(max(int(starts[-1]), table.num_rows - REGION)).combine_chunks().to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            table = table.combine_chunks()
            starts = _region_starts(table)
            if first:
                yield _border(table.slice(0, min(REGION, int(np.append(starts, table.num_rows)[1]))))
            yield _region_links(table, percent)
            yield _border(table.slice(max(int(starts[-1]), table.num_rows - REGION)))

    return run


def _keys(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("key").to_pylist()), dtype=">u4").reshape(table.num_rows, DEPTH)


def _region_starts(table: pa.Table) -> np.ndarray:
    heads = np.column_stack([table.column("tree").to_numpy(), _keys(table)[:, :LEAST_DEPTH]])
    return np.concatenate(([0], 1 + np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1))))


def _border(table: pa.Table) -> pa.RecordBatch:
    none = pa.nulls(table.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, *(table.column(c).combine_chunks() for c in range(5))], names=["a", "b", *table.column_names])


def _region_links(table: pa.Table, percent: int) -> pa.RecordBatch:
    """In each region a spanning forest, made of near neighbours first, of the pairs whose sizes and sketches allow the similarity."""
    starts = _region_starts(table)
    size = np.diff(np.append(starts, table.num_rows))
    rows = np.flatnonzero(np.repeat(size > 1, size))
    table = table.take(pa.array(rows)).combine_chunks()
    size = size[size > 1]
    at = np.concatenate(([0], np.cumsum(size)))
    region = np.repeat(np.arange(len(size)), size)
    doc, n = table.column("doc_id").to_numpy(), table.column("n_shingles").to_numpy()
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(rows), _VALUES // 4)
    key, label, least = _keys(table), np.arange(len(rows)), least_agreeing(percent)
    a: list[int] = []
    b: list[int] = []

    def alike(i, j: np.ndarray) -> np.ndarray:
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return (100 * small >= percent * large) & (_agree(bits[i], bits[j]) >= least)

    def join(i: int, j: int) -> None:
        if label[i] != label[j]:
            own = label[at[region[i]] : at[region[i] + 1]]
            own[own == label[j]] = label[i]
            a.append(i)
            b.append(j)

    for step in range(1, NEAR + 1):
        i = np.flatnonzero((region[:-step] == region[step:]) & (label[:-step] != label[step:])) if len(rows) > step else np.zeros(0, np.int64)
        for x in i[alike(i, i + step)].tolist():
            join(x, x + step)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        for s, e in _runs(key, lo, hi, LEAST_DEPTH):
            for i in range(s, e - NEAR - 1):
                if (label[s:e] == label[i]).all():
                    break
                others = i + NEAR + 1 + np.flatnonzero(label[i + NEAR + 1 : e] != label[i])
                for j in others[alike(i, others)].tolist():
                    join(i, j)
    none, no_bytes = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())
    tree = pa.array(table.column("tree").to_numpy()[a], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(doc[a], pa.int64()), pa.array(doc[b], pa.int64()), tree, no_bytes, none, none, no_bytes], names=["a", "b", *table.column_names])


def _confirm(percent: int):
    """Those of (a, b, set of a, set of b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(percent: int):
    """Links between components in rows sorted by (class, block, chunk): each row of the chunk against the rows of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            yield _group_links(group, percent)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = (1 + np.flatnonzero((k[1:] != k[:-1]).any(axis=1))).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            own = tuple(k[lo].tolist())
            if held and own != name:
                yield pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _group_links(group: pa.Table, percent: int) -> pa.RecordBatch:
    """A spanning forest, over components, of the links between the asking rows and the others."""
    doc, label = group.column("doc_id").to_numpy(), group.column("own").to_numpy().copy()
    asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("set").combine_chunks()]
    size = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(len(values), dtype=bool)
    a, b = [], []
    for i in np.flatnonzero(asks).tolist():
        small, large = np.minimum(size, size[i]), np.maximum(size, size[i])
        others = np.flatnonzero(~asks & (label != label[i]) & (100 * small >= percent * large))
        if not len(others):
            continue
        mark[flat[at[i] : at[i + 1]]] = True
        own = np.repeat(at[others] - np.cumsum(size[others]) + size[others], size[others]) + np.arange(size[others].sum())
        common = np.add.reduceat(mark[flat[own]], np.cumsum(size[others]) - size[others], dtype=np.int64)
        mark[flat[at[i] : at[i + 1]]] = False
        for j in others[100 * common >= percent * (size[i] + size[others] - common)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                a.append(doc[i])
                b.append(doc[j])
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id that links reach), kept (it is that id).

    Sets are the distinct 5-word shingles of the whole text (A-Z lower-cased, words end at ASCII white space); two sets are linked where
    100 * intersection >= percent * union. Texts without words are linked with nothing. Rows with equal sets are one class,
    found by digest. Rows with a NULL id take part in no link (component_id NULL, kept true); rows that repeat an id
    have the component of their own set each. Ids are whole numbers; what cannot be cast to one raises. Other columns are ignored.

    1. One representative of each distinct set enters the forest: in every tree the representatives are
       range-sorted by that tree's signature, so a hot region spans partitions; rows that share 2 values or more are candidates, and regions beyond
       1,024 rows go deeper. Whatever is cut (regions, batches, partitions), rows meet their 8 nearest on each side of the cut, and a region
       of up to 1,024 rows is always seen whole. Sketches drop pairs far below the similarity. What is left joins into candidate classes.
    2. The candidate links of three trees are confirmed on full sets, pair by pair. Where a class then falls into several components, the
       rows outside its largest one are compared with all rows of the class on full sets, block by block; nothing within a
       component is compared again, so a large family of copies costs little more than its links.
    3. Connected components of the confirmed links, and back to all rows by set digest.
    """
    sketch = stored(sketches(docs, id_col=id_col, text_col=text_col), "sketches")
    reps, found = _linked(docs, sketch, sketch.where("n_shingles > 0 and doc_id is not null"), id_col, text_col, percent)
    # The smallest id of a component of several sets; other sets have their own.
    least = reps.join(found, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    label = reps.join(found.join(least, "component").select("node", "least"), "node", "left").select(
        "digest", F.coalesce("least", "doc_id").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sketch.join(label, "digest", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: the smallest id (NULL last), of its texts the smallest
    SHA-256, of rows equal in both the smallest of all columns, in which maps count by their JSON. Columns may be of any type.

    Links are those of :func:`near_duplicates`, but between rows, whatever their ids: rows that share an id are apart where their texts are, and
    rows with a NULL id take part. Texts without words are linked with nothing; repeats of such an id and text count once.
    """
    sketch = stored(sketches(docs, id_col=id_col, text_col=text_col), "sketches")
    reps, found = _linked(docs, sketch, sketch.where("n_shingles > 0"), id_col, text_col, percent)
    kept = (
        reps.join(found, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
        .select("first.row")
        .unionByName(sketch.where("n_shingles = 0").select("row").distinct())
    )
    ordered = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    one = docs.groupBy(row_key(id_col, text_col).alias("row")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*ordered)).alias("all"))
    return one.join(kept.hint("shuffle_hash"), "row", "left_semi").select("all.*")


def _linked(docs: DataFrame, sketch: DataFrame, known: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of ``known`` rows of ``sketch`` (node, digest, n_shingles, and doc_id and row of the first), and
    (node, component) for those with links. Nodes are numbers of sets, as an id may have several sets or be NULL."""
    spark = docs.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    reps = stored(
        known.groupBy("digest").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.row", "n_shingles"), "reps"
    )
    candidates = _candidate_links(known, reps, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), percent)
    classes = stored(components(candidates), "classes")
    numbers = reps.join(classes, "node")
    sets = stored(
        _keyed(docs, id_col, text_col).select("text", "row")
        .join(numbers.select("row", "node").hint("shuffle_hash"), "row")
        .select(F.col("node").alias("doc_id"), "text")
        .mapInArrow(_sets, "doc_id long, set binary")
        .dropDuplicates(["doc_id"]),
        "sets",
    )
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    links = candidates.where(F.col("tree") < LINK_TREES).select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y")
    sure = stored(components(links.mapInArrow(_confirm(percent), "a long, b long")), "sure")

    rows = numbers.join(sure.withColumnRenamed("component", "own"), "node", "left").select(
        F.col("node").alias("doc_id"), F.col("component").alias("class"), F.coalesce("own", "node").alias("own"), "n_shingles"
    )
    parts = rows.groupBy("class", "own").agg(F.sum("n_shingles").alias("n"))
    apart = parts.groupBy("class").agg(F.max(F.struct("n", "own"))["own"].alias("main"), F.max("n").alias("largest"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks, chunks = (F.ceil(F.col(n) / BLOCK_SHINGLES).cast("int") for n in ("n", "others"))
    # Rows of one class may be many, so they meet their class' figures under 32 salts. Written, as both kinds of rows below come from it.
    figures = apart.select("class", "main", "n", (F.col("n") - F.col("largest")).alias("others"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    placed = stored(
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).join(figures, ["class", "salt"])
        .select("doc_id", "class", "own", (F.col("own") != F.col("main")).alias("minor"), blocks.alias("blocks"), chunks.alias("chunks")), "placed"
    )
    block, chunk = F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "chunks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.select("class", block.alias("b"), every("chunks").alias("c"), F.lit(False).alias("asks"), "doc_id", "own")
    asked = placed.where("minor").select("class", every("blocks").alias("b"), chunk.alias("c"), F.lit(True).alias("asks"), "doc_id", "own")
    more = (
        held.unionByName(asked).join(sets, "doc_id")
        .select("class", "b", "c", "asks", "doc_id", "own", "set")
        .repartition("class", "b", "c")
        .sortWithinPartitions("class", "b", "c", "doc_id")
        .mapInArrow(_links(percent), "a long, b long")
    )
    return reps, components(sure.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _candidate_links(known: DataFrame, reps: DataFrame, parts: int, percent: int) -> DataFrame:
    """Candidate links (a, b, tree) of nodes: of all trees' sorted orders, and of the regions at the borders of partitions."""
    own = (
        known.select("digest", "row", "n_shingles", "sketch", "keys")
        .join(reps.select("digest", "row", "node"), ["digest", "row"])
        .dropDuplicates(["digest"])
    )
    names = [c.split()[0] for c in _TREE_ROW.split(", ")]
    trees = stored(own.select(F.posexplode("keys").alias("tree", "key"), F.col("node").alias("doc_id"), "n_shingles", "sketch").select(*names), "trees")
    find = lambda df, n: df.repartitionByRange(n, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id").mapInArrow(_candidates(percent), _CANDIDATE)
    inner = stored(find(trees, parts), "inner")
    drop(trees)
    # Regions met at borders come together again, dealt by tree and shared values; those of many partitions are cut once more, but elsewhere.
    outer = find(inner.where("a is null").select(*names).distinct(), max(1, parts // 16))
    both = inner.where("a is not null").select("a", "b", "tree").unionByName(outer.where("a is not null").select("a", "b", "tree"))
    found = stored(both, "candidates")
    drop(inner)
    return found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        h, at = shingle_hashes(batch.column(1))
        sets = [np.unique(h[s:e]).tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "set": pa.array(sets, pa.binary())})
