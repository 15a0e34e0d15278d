"""Phrase collocations: sketch upper bounds propose phrases, delimiter-guarded automata count them, thresholds decide.

The corpus is cut into shards of one language. Every shard hashes its phrases of all sizes into the cells of one sketch and sends
the cells' counts, packed by range of cells, to where a range is summed: no phrase occurs more often than its cell. The cells that reach
the threshold go back to the shards that have them. A shard compiles its own phrases in those cells into an Aho-Corasick
automaton, every word between blanks, and counts all matches, overlaps included; counts are summed over the shards. So an automaton is bounded
by its shard and a range by the sketch's width, whatever the corpus' size, and counts are exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import pack, pack_keys, unpack, unpack_keys
from .scratch import drop, stored
from .words import SPACES, mix, pieces, same_words, word_bounds, word_hashes

#: Bytes of text that are read together, and of a shard; a piece between delimiters is never cut.
PIECE_BYTES, SHARD_BYTES = 2 << 20, 4 << 20
#: Cells of a range of the sketch (2 to this power), and the most ranges.
RANGE_BITS, MOST_RANGES = 22, 1 << 16
#: Parts of a hot phrase's rows in joins; shards that are counted in one task, if they are of one language.
SALTS, GROUP = 16, 16

#: Bytes as shards hold them: A-Z lower-cased, blanks between words, line ends between pieces.
_PLAIN = bytes.maketrans(bytes(range(0x41, 0x5B)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(0x61, 0x7B)) + b" " + b"\n" * 9)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plain_pieces(raw: bytes) -> bytes:
    """Pieces between line ends, each of words between single blanks, with a blank at both ends."""
    low = re.sub(rb" *\n[ \n]*", b" \n ", raw.translate(_PLAIN))
    return re.sub(rb"  +", b" ", b" " + low + b" ")


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about ``limit`` bytes, cut between pieces only."""
    at = 0
    while len(text) - at > limit:
        stop = text.rfind(b"\n", at, at + limit)
        stop = stop if stop > at else text.find(b"\n", at + limit)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    made = 0

    def shard(lang: str, text: bytes) -> pa.RecordBatch:
        nonlocal made
        made += 1
        data = np.frombuffer(text, np.uint8)
        n = len(word_bounds(data, np.array([0, len(data)]), ~SPACES)[0])
        name = f"{TaskContext.get().partitionId()}-{made}"
        return pa.RecordBatch.from_pydict({
            "shard": [name], "lang": [lang], "n_words": pa.array([n], pa.int64()), "size": pa.array([len(text)], pa.int64()), "text": pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())
        })

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        text = plain_pieces(b"\n".join(held.pop(lang)))
        for part in _cut(text, len(text) // max(1, round(len(text) / SHARD_BYTES)) + (64 << 10)):
            yield shard(lang, part)
        del sizes[lang]

    for batch in pieces(batches, "text", PIECE_BYTES):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
        while sizes and (max(sizes.values()) >= SHARD_BYTES or sum(sizes.values()) >= 4 * SHARD_BYTES):
            yield from flush(max(sizes, key=sizes.get))
    for lang in sorted(held):
        yield from flush(lang)


def _text_of(rows: pa.RecordBatch | pa.Table, i: int) -> bytes:
    return pa.decompress(rows.column("text")[i].as_py(), rows.column("size")[i].as_py(), "zstd", asbytes=True)


def _phrases(text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the size, where its phrases begin (numbers of words), their numbers (equal ones, and only these, have one) and hashes, and the
    words' starts and ends."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ~SPACES)
    if not len(starts):
        return
    hashes = word_hashes(data, starts, ends)
    _, once, number = np.unique(hashes, return_index=True, return_inverse=True)
    if not same_words(data, starts, ends, data, starts[once][number], ends[once][number]).all():  # two words of one hash
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
    piece = np.searchsorted(np.flatnonzero(data == 0x0A), starts).astype(np.int32)
    n, width = number.astype(np.int32), int(number.max()) + 1
    at, h, own = np.arange(len(starts), dtype=np.int32), mix(hashes), n
    del once, number, data
    yield 1, at, own, h, starts, ends
    for size in range(2, longest + 1):
        keep = np.flatnonzero(at + size - 1 < len(starts)).astype(np.int32)
        keep = keep[piece[at[keep]] == piece[at[keep] + size - 1]]
        at = at[keep]
        if not len(at):
            return
        h = mix(h[keep] * _ODD ^ hashes[at + size - 1])
        own = np.unique(own[keep].astype(np.int64) * width + n[at + size - 1], return_inverse=True)[1].astype(np.int32)
        yield size, at, own, h, starts, ends


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _cells(hashes: np.ndarray, lang: str, bits: int) -> np.ndarray:
    return (mix(hashes ^ _salt(lang)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketcher(bits: int, longest: int):
    """For each shard and range of cells: which cells its phrases fall into, and how often."""
    low = min(bits, RANGE_BITS) if bits - RANGE_BITS <= MOST_RANGES.bit_length() - 1 else bits - MOST_RANGES.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang = (batch.column(c)[i].as_py() for c in ("shard", "lang"))
                parts = [_cells(h, lang, bits) for _, _, _, h, _, _ in _phrases(_text_of(batch, i), longest)]
                if not parts:
                    continue
                cells, counts = np.unique(np.concatenate(parts), return_counts=True)
                del parts
                of = cells >> low
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                stops = np.append(heads[1:], len(cells))
                yield pa.RecordBatch.from_pydict({
                    "shard": [shard] * len(heads), "lang": [lang] * len(heads), "range": pa.array(of[heads], pa.int64()),
                    "cells": pa.array([pack_keys(cells[a:b] - (of[a] << low)) for a, b in zip(heads.tolist(), stops.tolist())], pa.binary()),
                    "counts": pa.array([pack(counts[a:b]) for a, b in zip(heads.tolist(), stops.tolist())], pa.binary()),
                })

    def frequent(least: int):
        def run(table: pa.Table) -> pa.Table:
            """One range: the shards' cells whose sum reaches the threshold. Its size is the sketch's share, as hashes spread evenly and a shard
            counts each of its cells once."""
            rows = table.to_pydict()
            keys = [unpack_keys(c) for c in rows["cells"]]
            total = np.zeros(1 << low, np.int64)
            for k, c in zip(keys, rows["counts"]):
                total[k] += unpack(c)
            hits = [k[total[k] >= least] for k in keys]
            live = [i for i, k in enumerate(hits) if len(k)]
            return pa.table({
                "shard": pa.array([rows["shard"][i] for i in live], pa.string()), "lang": pa.array([rows["lang"][i] for i in live], pa.string()), "range": pa.array([rows["range"][i] for i in live], pa.int64()),
                "cells": pa.array([pack_keys(hits[i]) for i in live], pa.binary()),
            })

        return run

    return low, run, frequent


def _counter(bits: int, low: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's frequent cells, then its text: the phrases in those cells, compiled and counted."""
        held: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                at, cells = (batch.column(c)[i].as_py() for c in ("range", "cells"))
                if cells is not None:
                    held.append(unpack_keys(cells) + (at << low))
                    continue
                if held:
                    live, lang = np.sort(np.concatenate(held)), batch.column("lang")[i].as_py()
                    held = []
                    keys, sizes, counts = _counted(_text_of(batch, i), lang, live, bits, longest)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(keys), pa.string()), "size": pa.array(sizes, pa.int32()), "phrase": pa.array([k[1:-1] for k in keys], pa.string()),
                        "n": pa.array(counts, pa.int64()),
                    })

    return run


def _counted(text: bytes, lang: str, live: np.ndarray, bits: int, longest: int) -> tuple[list[str], list[int], np.ndarray]:
    """The phrases of a shard in the cells ``live``, a blank before and after each, their sizes, and how often they occur."""
    keys: list[str] = []
    sizes: list[int] = []
    for size, at, own, hashes, starts, ends in _phrases(text, longest):
        cells = _cells(hashes, lang, bits)
        near = np.searchsorted(live, cells)
        hit = np.flatnonzero(live[np.minimum(near, len(live) - 1)] == cells)
        first = at[hit[np.unique(own[hit], return_index=True)[1]]]
        # Words of a piece stand between single blanks, so a phrase is one slice.
        keys += [text[a:b].decode() for a, b in zip((starts[first] - 1).tolist(), (ends[first + size - 1] + 1).tolist())]
        sizes += [size] * len(first)
    if not keys:
        return keys, sizes, np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, key in enumerate(keys):
        automaton.add_word(key, i)
    automaton.make_automaton()
    return keys, sizes, np.bincount(np.fromiter((i for _, i in automaton.iter(text.decode())), np.int64), minlength=len(keys))


def phrase_counts(docs: DataFrame, *, least: int = 10, longest: int = 3, lang_col: str = "lang", text_col: str = "text", bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``size``, ``phrase``, ``n`` of every phrase of 1 to ``longest`` words that occurs at least ``least`` times in its language, and
    ``lang``, ``n``: all its words. Words are ``[^\\x20\\x09]+`` with A-Z lower-cased, in pieces between ``[.,;:!?\\x0A-\\x0D]``.

    NULL languages are ``und``; NULL and empty texts and texts of delimiters have no words; rows that repeat count each. Texts of any length are cut
    between pieces. ``bits`` sets the sketch's width; by default it follows the number of words. Other columns are ignored, whatever their names. An
    empty table gives empty results.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = stored(rows.mapInArrow(_sharded, "shard string, lang string, n_words long, size long, text binary"), "shards")
    words = shards.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    made = shards.agg(F.sum("n_words").alias("words"), F.count("*").alias("shards")).first()
    bits = bits or max(16, int(2 * (made["words"] or 0)).bit_length())
    low, sketch, frequent = _sketcher(bits, longest)
    cells = shards.select("shard", "lang", "size", "text").mapInArrow(sketch, "shard string, lang string, range long, cells binary, counts binary")
    found = cells.groupBy("range").applyInArrow(frequent(least), "shard string, lang string, range long, cells binary")
    # A few shards of one language come to one task, each shard's cells before its text, so that what they share is added up there.
    both = shards.select("shard", "lang", "size", "text").unionByName(found, allowMissingColumns=True)
    dealt = both.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(max(1, made["shards"] // GROUP)))).repartition("lang", "group")
    ordered = dealt.sortWithinPartitions("lang", "group", "shard", F.col("cells").isNull()).select("lang", "range", "cells", "size", "text")
    counted = ordered.mapInArrow(_counter(bits, low, longest), "lang string, size int, phrase string, n long")
    counts = stored(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    words = stored(words, "words")
    drop(shards)
    return counts, words


def _ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)) without rounding: counts below 10^14 keep within 38 digits, and none exceeds its parts."""
    d = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * d(a) * d(a), d(left) * d(right))


def collocations(docs: DataFrame, *, least: int = 10, longest: int = 3, inside_percent: int = 50, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``most`` best phrases of 2 to ``longest`` words by language: lang, rank, phrase, a (occurrences), l and r (those of the two parts at
    the cut that scores lowest), n (the language's words), score.

    A phrase goes where a longer candidate that holds it has at least ``inside_percent`` % of its occurrences. Ties go to more occurrences, then to
    the phrase in byte order; of cuts, to the first. Other cases as in :func:`phrase_counts`.
    """
    counts, words = phrase_counts(docs, least=least, longest=longest, lang_col=lang_col, text_col=text_col)
    w = F.split("phrase", " ")
    part = lambda c, a, n: F.array_join(F.slice(c, a, n), " ")
    cands = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), w.alias("w"))
    cuts = cands.select(
        "lang", "a",
        F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.col("w"), F.lit(1), k).alias("left"), part(F.col("w"), k + 1, F.col("size") - k).alias("right")))).alias("cut"),
    ).select("lang", "a", "cut.*")
    # A frequent word begins or ends many phrases: its one row is repeated for each part of them.
    zero, salts = F.lit(0).cast("long"), F.lit(SALTS).cast("long")
    copies = counts.select("lang", "phrase", "n", F.explode(F.when(F.col("size") == 1, F.sequence(zero, salts - 1)).otherwise(F.array(zero))).alias("salt"))
    for side, other, name in (("left", "right", "l"), ("right", "left", "r")):
        salted = cuts.withColumn("salt", F.when(F.contains(side, F.lit(" ")), zero).otherwise(F.pmod(F.xxhash64(other), salts)))
        cuts = salted.join(copies.select("lang", F.col("phrase").alias(side), "salt", F.col("n").alias(name)), ["lang", side, "salt"]).drop("salt")
    scored = cuts.select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "a", "k", "l", "r", _ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    whole = cands.where("size >= 3").select("lang", "size", "w", "a")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(F.col("w"), i, n))))
    inside = whole.select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    order = [F.desc("b.score"), F.desc("a"), "phrase"]
    # The best of each part of a language first, so that one task sees SALTS * most rows of it at most.
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
