"""Benchmark decontamination with suffix arrays over shards of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored
from .words import ALNUM, pieces, same_words, text_bytes, word_bounds, word_hashes

#: Bytes of text in a shard, and of benchmark text that is searched for in one pass over the corpus.
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20


class SuffixArray:
    """The suffixes of a shard's word sequences in order of their first ``depth`` words or more.

    Words are numbered from 1 by their hash; a 0 ends each text. The first sort
    packs as many words as fit 63 bits into a key; then prefix doubling sorts only those suffixes that are still tied.
    """

    def __init__(self, hashes: np.ndarray, first_word: np.ndarray, depth: int) -> None:
        n_texts = len(first_word) - 1
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        #: Place of each word in ``seq``, and of each text's first word.
        self.text_of = np.repeat(np.arange(n_texts), np.diff(first_word))
        self.seq = np.zeros(len(hashes) + n_texts, dtype=np.int64)
        self.seq[np.arange(len(hashes)) + self.text_of] = ids + 1
        self.first = first_word[:-1] + np.arange(n_texts)
        n = len(self.seq)
        self.bits = int(len(self.vocabulary)).bit_length() + 1
        self.packed = max(1, 63 // self.bits)
        key = np.zeros(n, dtype=np.int64)
        for j in range(self.packed):
            key <<= self.bits
            if j < n:
                key[: n - j] |= self.seq[j:]
        self.order = np.argsort(key)
        self.keys = key[self.order]
        new = np.ones(n, dtype=bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        rank = np.empty(n, dtype=np.int64)
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[self.order] = place
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        done = self.packed
        while done < depth and len(tied):
            at = self.order[tied]
            then = at + done
            second = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
            pair = (rank[at] << 32) | second
            by = np.argsort(pair)
            at, pair = at[by], pair[by]
            self.order[tied] = at
            starts = np.ones(len(tied), dtype=bool)
            starts[1:] = pair[1:] != pair[:-1]
            rank[at] = np.maximum.accumulate(np.where(starts, tied, 0))
            tied = tied[~starts | np.append(~starts[1:], False)]
            done *= 2

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for those that the shard lacks."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == hashes, k + 1, -1)

    def ranges(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix ``words[start : start + length]`` the range of suffixes that begin with it."""
        low = np.zeros(len(starts), dtype=np.int64)
        some = np.ones(len(starts), dtype=bool)
        for j in range(self.packed):
            use = j < lengths
            w = np.where(use, words[np.minimum(starts + j, len(words) - 1)], 0)
            some &= w >= 0
            low = (low << self.bits) | np.maximum(w, 0)
        width = np.left_shift(1, self.bits * np.maximum(self.packed - lengths, 0))
        lo = np.searchsorted(self.keys, low)
        hi = np.where(some, np.searchsorted(self.keys, low + width), lo)
        live = np.flatnonzero((hi > lo) & (lengths > self.packed))
        lo[live], hi[live] = self._narrow(words, starts[live], lengths[live], lo[live], hi[live])
        return lo, hi

    def _narrow(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search for all test suffixes in step: the first suffix not below, and the first above."""
        found = []
        for upper in (False, True):
            a, b = lo.copy(), hi.copy()
            while len(live := np.flatnonzero(a < b)):
                mid = (a[live] + b[live]) >> 1
                sign = self._compare(words, starts[live], lengths[live], self.order[mid])
                right = (sign <= 0) if upper else (sign < 0)
                a[live] = np.where(right, mid + 1, a[live])
                b[live] = np.where(right, b[live], mid)
            found.append(a)
        return found[0], found[1]

    def _compare(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sign of shard suffix against test suffix over its length."""
        sign = np.zeros(len(starts), dtype=np.int64)
        open_ = np.arange(len(starts))
        for j in range(int(lengths.max(initial=0))):
            open_ = open_[lengths[open_] > j]
            if not len(open_):
                break
            here = at[open_] + j
            ours = np.where(here < len(self.seq), self.seq[np.minimum(here, len(self.seq) - 1)], -2)
            s = np.sign(ours - words[starts[open_] + j])
            sign[open_] = s
            open_ = open_[s == 0]
        return sign


@dataclass
class TestBlock:
    """The word sequences of benchmark items that are searched for together, and every test suffix's length."""

    ids: list[str]
    window: int = 10

    @classmethod
    def of(cls, ids: list[str], texts: list[str], window: int) -> TestBlock:
        block = cls(ids, window=window)
        data, at = text_bytes(pa.array(texts, pa.large_string()))
        starts, ends, first = word_bounds(data, at, ALNUM)
        n = np.diff(first)
        block.item = np.repeat(np.arange(len(ids)), n)
        left = np.repeat(first[1:], n) - np.arange(first[-1])
        whole = np.repeat(n, n)
        block.head = np.arange(first[-1]) == np.repeat(first[:-1], n)
        #: Words that a test suffix must share to count: a window, or the whole of a shorter item.
        block.need = np.where(left >= window, window, np.where(block.head, whole, 0))
        block.left = left
        block.raw = (data, starts, ends)
        block._windows()
        return block

    def hashes(self, seed: int) -> np.ndarray:
        return word_hashes(*self.raw, seed=seed)

    def _windows(self) -> None:
        """Different windows once each, with the test suffixes that begin with each: equal windows are searched for together."""
        self.query = np.flatnonzero(self.need > 0)
        words = _numbers(self.raw)[0].astype(np.int64)
        rows = np.full((len(self.query), int(self.need.max(initial=0))), -1, dtype=np.int64)
        for j in range(rows.shape[1]):
            use = self.need[self.query] > j
            rows[use, j] = words[self.query[use] + j]
        _, once, group = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
        #: The first test suffix of each window, and all of them in order of their window.
        self.once = self.query[once]
        order = np.argsort(group.ravel(), kind="stable")
        self.members = self.query[order]
        self.member_at = np.searchsorted(group.ravel()[order], np.arange(len(once) + 1))


def _bytes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    low = bytes(data).lower()
    return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


#: Seeds under which a shard's words are hashed in turn before they are numbered by their bytes.
SEEDS = 3
#: Occurrences that are extended at a time.
_STEP = 1 << 18


def _numbers(*raws: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Numbers of the words of several texts, equal where their bytes are."""
    number: dict[bytes, int] = {}
    return [np.array([number.setdefault(w, len(number)) for w in _bytes_of(*raw)], dtype=np.uint64) for raw in raws]


def search_shard(column: pa.Array, block: TestBlock) -> dict[str, list]:
    """Per text: words, hit words as merged spans (first word, end), items with occurring windows, longest match.

    Longest matches are extended from the first window of each stretch that both texts share to its end.
    Hash matches are confirmed byte for byte; should one fail, the shard is searched again under another seed, and after ``SEEDS`` of them with
    words numbered by their bytes.
    """
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at, ALNUM)
    n = len(column)
    out: dict[str, list] = {"n_words": np.diff(first).tolist(), "spans": [[] for _ in range(n)], "items": [[] for _ in range(n)], "longest": [0] * n}
    if not len(starts) or not len(block.once):
        return out
    for seed in range(SEEDS + 1):
        if seed < SEEDS:
            own, tests = word_hashes(data, starts, ends, seed), block.hashes(seed)
        else:
            own, tests = _numbers((data, starts, ends), block.raw)
        array = SuffixArray(own, first, int(block.need.max()))
        words = array.ids(tests)
        lo, hi = array.ranges(words, block.once, block.need[block.once])
        times = hi - lo
        if not times.sum():
            return out
        w = np.repeat(np.arange(len(times)), times)
        place = array.order[_ranges(lo, times)]
        need = block.need[block.once][w]
        edge = np.zeros(len(array.seq) + 1, dtype=np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + need, -1)
        hit = np.cumsum(edge[:-1]) > 0
        spots = np.flatnonzero(hit)
        word = spots - np.searchsorted(array.first, spots, "right") + 1
        known, back = np.unique(tests, return_index=True)
        which = back[np.searchsorted(known, own[word])]
        test_data, test_starts, test_ends = block.raw
        if seed == SEEDS or same_words(data, starts[word], ends[word], test_data, test_starts[which], test_ends[which]).all():
            break
    flips = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    for s, e in zip(flips[::2].tolist(), flips[1::2].tolist()):
        d = int(np.searchsorted(array.first, s, "right")) - 1
        out["spans"][d].append((s - int(array.first[d]), e - int(array.first[d])))
    doc = np.searchsorted(array.first, place, "right") - 1
    for pair in np.unique(doc * len(times) + w).tolist():
        d, k = divmod(pair, len(times))
        out["items"][d] += [block.ids[i] for i in block.item[block.members[block.member_at[k] : block.member_at[k + 1]]].tolist()]
    out["items"] = [sorted(set(x)) for x in out["items"]]
    out["longest"] = _longest(array.seq, words, block, w, place, doc, n).tolist()
    return out


def _ranges(lo: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each range, one range after another."""
    return np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())


def _longest(seq: np.ndarray, words: np.ndarray, block: TestBlock, w: np.ndarray, place: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The longest match of each text, in words. Every occurrence meets every test suffix that begins with its window, some at a time."""
    best = np.zeros(n, dtype=np.int64)
    times = (block.member_at[1:] - block.member_at[:-1])[w]
    upto = np.cumsum(times)
    lo = 0
    while lo < len(w):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _STEP, "right")))
        own = np.repeat(np.arange(lo, hi), times[lo:hi])
        q = block.members[_ranges(block.member_at[w[lo:hi]], times[lo:hi])]
        at = place[own]
        # One word to the left both go on alike: that occurrence's window begins the same stretch.
        first = block.head[q] | (at == 0) | (seq[np.maximum(at - 1, 0)] != words[np.maximum(q - 1, 0)])
        own, q, at = own[first], q[first], at[first]
        need = block.need[q]
        np.maximum.at(best, doc[own], need + _extend(seq, words, at + need, q + need, block.left[q] - need))
        lo = hi
    return best


def _extend(seq: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How many more words two sequences share from ``a`` and ``b``, up to ``left``."""
    more = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(left > 0)
    while len(live):
        same = seq[np.minimum(a[live] + more[live], len(seq) - 1)] == words[b[live] + more[live]]
        live = live[same]
        more[live] += 1
        live = live[more[live] < left[live]]
    return more


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[tuple[int, bool, TestBlock]]:
    """The benchmark in blocks of bounded size, one at a time on the driver: number, whether it is the last, block. Repeated rows count once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 1).alias("b")).first()["b"] or 0
    n = max(1, -(-int(size) // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow().to_pydict()
        yield k, k == n - 1, TestBlock.of(rows["id"], rows["text"], window)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: id, n_words, spans of hit words (merged), items (distinct, sorted), longest match in words.

    A word is a run of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Every test suffix
    of ``window`` words (a shorter item: the whole) is binary-searched in the suffix array
    of every shard: a few MB of whole texts, built where the texts are read, so no text is shuffled.
    The benchmark goes out in blocks of ``block_bytes``, as many passes as it needs. NULL and empty texts
    have no words; repeated rows are rows of their own; items with NULL id or no words match
    nothing; repeated item ids count once. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    for k, last, block in _blocks(benchmark, item_id, item_text, window, block_bytes):
        held = sc.broadcast(block)
        if k:  # what the blocks before have found is carried along with the text
            out = stored(out, "matches")
        text = [] if last else [T.StructField("_text", T.StringType())]
        out = out.mapInArrow(_matcher(held, bool(k), last), T.StructType([out.schema["_id"], *text, *_FOUND]))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"), "longest"
    )


def _matcher(held, carry: bool, last: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", SHARD_BYTES):
            found = search_shard(batch.column(1), held.value)
            if carry:
                for i, (spans, items, longest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("spans", "items", "longest")))):
                    found["spans"][i] = _merged([*found["spans"][i], *((s["start"], s["end"]) for s in spans)])
                    found["items"][i] += items
                    found["longest"][i] = max(found["longest"][i], longest)
            spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in found["spans"]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = {"_id": batch.column(0)} | ({} if last else {"_text": batch.column(1)})
            columns |= {"n_words": pa.array(found["n_words"], pa.int64()), "spans": spans}
            columns |= {"items": pa.array(found["items"], pa.list_(pa.string())), "longest": pa.array(found["longest"], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return match


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without_matches(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs. See :func:`benchmark_matches`."""
    sc = docs.sparkSession.sparkContext
    for k, _, block in _blocks(benchmark, item_id, item_text, window, block_bytes):
        held = sc.broadcast(block)
        if k:
            docs = stored(docs, "clean")

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col, SHARD_BYTES):
                found = search_shard(batch.column(batch.schema.get_field_index(text_col)), held.value)
                yield batch.filter(pa.array([not s for s in found["spans"]], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def match_digests(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items for each row of :func:`benchmark_matches`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return matches.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
