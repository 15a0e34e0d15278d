"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .words import ALNUM, lowered, mix, pieces, text_bytes, word_bounds, word_hashes

PIECE_BYTES = 2 << 20

# The seed lexicon. Labels add insults to it and weigh all of them.
INSULTS = (
    "ass asshole bastard bitch bimbo bum clown coward creep cretin crook degenerate dickhead dimwit dirtbag disgrace disgusting douche dumb dumbass "
    "dummy dunce filth filthy fool freak garbage halfwit hag hypocrite idiot idiotic ignoramus imbecile jackass jerk laughable lazy liar loser lowlife "
    "lunatic maggot moron moronic nitwit nobody numbskull oaf parasite pathetic pest pig pitiful prick psycho repulsive retard revolting rotten scoundrel "
    "scum scumbag sewer shameless shit sleazy slime slob slut stupid swine thug trash twat twit ugly useless vermin vile weasel whore wimp worthless wretch "
    "idiota imbecil estupido estúpido basura payaso tonto perdedor asqueroso idiote imbécile stupide ordure crétin clochard minable dégoûtant "
    "trottel dummkopf abschaum versager widerlich wertlos erbärmlich idioten"
).split()
THREATS = (
    "kill hurt destroy murder beat stab shoot crush strangle smash punish attack burn bury hang break choke slap punch "
    "matar golpear tuer frapper töten schlagen umbringen"
).split()
TARGETS = (
    "you your yours yourself u ur he him his she her they them their these those people everyone all tu te ti usted vos vous toi ton votre du dich dir dein ihr"
).split()
NEGATIONS = (
    "not no never nobody none neither nor without don doesn didn isn aren wasn weren won wouldn can cannot couldn shouldn hardly "
    "ni nunca jamás jamais nicht kein keine niemals"
).split()
REPORTS = (
    "said says say saying told called calls claimed claims wrote writes reported reports alleged according quoted quote quotes "
    "shouted accused dijo dit sagte"
).split()
MODALS = "will ll gonna going shall must should want voy vais werde".split()

#: Input symbols: insult, word with the opening of insults, threat verb, target, negation, report, modal, other word, end of clause.
INPUT = "ISTYNRMOE"
#: Output symbols that count: plain, targeted and reported insult, negated insult or threat, threat, bare threat verb, reported threat, opening.
OUTPUT = "IJrnHTuS"
#: Characters in a learned opening.
OPENINGS = range(3, 9)


@dataclass
class Transducer:
    """A deterministic transducer: ``arcs[state, symbol] = (next state, output, weight)``; a missing arc passes the symbol on
    and goes to ``rest[state]`` with weight 1."""

    arcs: dict[tuple[object, str], tuple[object, str, float]]
    rest: dict[object, object]
    start: object = 0

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, self.start), symbol, 1.0)


@dataclass
class Composed:
    """The composition of transducers, each reading what the one before it writes; product arcs are kept as they come up."""

    parts: tuple[Transducer, ...]
    arcs: dict[tuple[tuple, str], tuple[tuple, str, float]] = field(default_factory=dict)

    @property
    def start(self) -> tuple:
        return tuple(p.start for p in self.parts)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        found = self.arcs.get((state, symbol))
        if found is None:
            after, out, weight = [], symbol, 1.0
            for part, s in zip(self.parts, state):
                t, out, w = part.step(s, out)
                after.append(t)
                weight *= w
            found = self.arcs[state, symbol] = (tuple(after), out, weight)
        return found


def _negation(scope: int = 3) -> Transducer:
    """Insults, openings and threats within ``scope`` words after a negation become ``n``."""
    arcs: dict = {(s, "N"): (scope, "N", 1.0) for s in range(scope + 1)} | {(s, "E"): (0, "E", 1.0) for s in range(scope + 1)}
    for s in range(1, scope + 1):
        arcs |= {(s, x): (s - 1, "n", 1.0) for x in "ITS"}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(scope + 1)})


def _report() -> Transducer:
    """What follows a verb of speech in its clause is reported: insults become ``r``, threats ``u``."""
    arcs = {(0, "R"): (1, "R", 1.0), (1, "I"): (1, "r", 1.0), (1, "S"): (1, "r", 1.0), (1, "T"): (1, "u", 1.0), (1, "E"): (0, "E", 1.0)}
    return Transducer(arcs, {0: 0, 1: 1})


def _threat(scope: int = 3) -> Transducer:
    """A threat verb within ``scope`` words after a modal is a threat ``H``; with neither modal nor target it stays ``T``."""
    arcs: dict = {(s, "M"): (scope, "M", 1.0) for s in range(scope + 1)} | {(s, "E"): (0, "E", 1.0) for s in range(scope + 1)}
    arcs |= {(s, "T"): (0, "H", 1.0) for s in range(1, scope + 1)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(scope + 1)})


def _target(scope: int = 4) -> Transducer:
    """An insult within ``scope`` words after a target is a targeted one, ``J``; a threat verb there weighs more."""
    arcs: dict = {(s, "Y"): (scope, "Y", 1.0) for s in range(scope + 1)} | {(s, "E"): (0, "E", 1.0) for s in range(scope + 1)}
    for s in range(1, scope + 1):
        arcs |= {(s, "I"): (scope, "J", 1.0), (s, "H"): (scope, "H", 1.5)}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(scope + 1)})


def grammar() -> Composed:
    """Negation, then reported speech, then threats, then targets."""
    return Composed((_negation(), _report(), _threat(), _target()))


@dataclass
class ToxicityModel:
    """Symbol and weight of each lexicon word, weights of openings (by their characters), and the logistic weights: bias, the
    grammar's outputs, the density of matched words, the length."""

    lexicon: dict[str, tuple[str, float]]
    weights: np.ndarray
    openings: dict[str, float] = field(default_factory=dict)

    def tables(self) -> Tables:
        hashes, order = _hash_table(list(self.lexicon))
        found = [list(self.lexicon.values())[i] for i in order]
        by_size = {}
        for k in sorted({len(o) for o in self.openings}, reverse=True):
            own = [o for o in self.openings if len(o) == k]
            h, by = _hash_table(own)
            by_size[k] = (h, np.array([self.openings[own[i]] for i in by]))
        return Tables(hashes, np.array([x for x, _ in found], dtype="U1"), np.array([w for _, w in found]), by_size)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + scaled(features) @ self.weights[1:], -30, 30)))


def _hash_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and the place of each one's word."""
    data, at = text_bytes(pa.array(words, pa.large_string()))
    hashes = word_hashes(data, at[:-1], at[1:])
    order = np.argsort(hashes)
    return hashes[order], order


def _look_up(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    k = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return k, table[k] == hashes


@dataclass
class Tables:
    """The first transducer, from words to symbols: whole words, then the longest opening that a word goes beyond."""

    hashes: np.ndarray
    symbols: np.ndarray
    weights: np.ndarray
    openings: dict[int, tuple[np.ndarray, np.ndarray]]

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word; O where neither it nor an opening is known. Each different word is looked up once."""
        h, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        symbols, weights = np.full(len(h), "O", dtype="U1"), np.ones(len(h))
        k, known = _look_up(h, self.hashes)
        if known.any():
            symbols[known], weights[known] = self.symbols[k[known]], self.weights[k[known]]
        open_ = np.flatnonzero(~known)
        characters = _characters(data)
        for size, (table, own) in self.openings.items():
            s, e = starts[first[open_]], ends[first[open_]]
            stop = _opening_ends(characters, s, e, size)
            longer = np.flatnonzero(stop > 0)
            k, hit = _look_up(word_hashes(data, s[longer], stop[longer]), table)
            found = open_[longer[hit]]
            symbols[found], weights[found] = "S", own[k[hit]]
            open_ = np.setdiff1d(open_, found, assume_unique=True)
        return symbols[back], weights[back]


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters begin in UTF-8 bytes, and the number of each byte's character."""
    head = (data & 0xC0) != 0x80
    return np.flatnonzero(head), np.cumsum(head) - 1


def _opening_ends(characters: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Where the first ``size`` characters of each word end; -1 for words that are no longer than that."""
    heads, number = characters
    if not len(starts):
        return np.zeros(0, np.int64)
    at = number[starts] + size
    stop = heads[np.minimum(at, len(heads) - 1)]
    return np.where((at < len(heads)) & (stop < ends), stop, -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Summed clause weights on a scale from 0 to 1 (one clear clause counts most, more add little), matched words by length,
    and the length's logarithm."""
    sums, n = x[:, : len(OUTPUT)], x[:, -1]
    hot = sums[:, [OUTPUT.index(c) for c in "IJHS"]].sum(axis=1)
    return np.column_stack([sums / (sums + 0.5), 10 * hot / (n + 10), np.log1p(n) / 5])


_ENDS = np.isin(np.arange(256), list(b".!?;:|\n\r"))


def clause_features(column: pa.Array, tables: Tables, machine: Composed) -> tuple[np.ndarray, np.ndarray]:
    """(texts, outputs and words): summed weights of the matched clauses of each text and its number of words; and how many clauses matched."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at, ALNUM)
    out, matched = np.zeros((len(column), len(OUTPUT) + 1)), np.zeros(len(column), np.int64)
    out[:, -1] = np.diff(first)
    if not len(starts):
        return out, matched
    symbols, weights = tables.read(data, starts, ends)
    hits = np.flatnonzero(symbols != "O")
    if not len(hits):
        return out, matched
    text = np.searchsorted(first, hits, "right") - 1
    stops = np.cumsum(_ENDS[data])
    clause = stops[starts[hits]] + text  # texts end clauses, too
    sym, weight = symbols[hits], weights[hits]
    core = np.unique(clause[np.isin(sym, ["I", "S", "T"])])
    live = np.flatnonzero(np.isin(clause, core))
    state, before, own = machine.start, -1, None
    for i in live.tolist():
        c = (int(text[i]), int(clause[i]))
        if c != own:
            state, own, any_ = machine.step(state, "E")[0], c, False
        else:
            for _ in range(min(5, int(hits[i]) - before - 1)):
                state = machine.step(state, "O")[0]
        before = int(hits[i])
        state, symbol, w = machine.step(state, str(sym[i]))
        j = OUTPUT.find(symbol)
        if j >= 0:
            out[c[0], j] += w * weight[i]
            matched[c[0]] += not any_
            any_ = True
    return out, matched


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000
) -> ToxicityModel:
    """Learn from labelled rows of ``labels`` (id, 0 or 1), the first ``max_rows`` of them by a hash of the id.

    Equal texts count once (toxic if any is). Whole words and word openings become insults and suspect openings by their evidence (:func:`_learned`);
    seed words with contrary evidence lose their weight. Logistic weights of the grammar's outputs then start from priors,
    which hold where the labels say nothing. Without labels, seeds and priors remain. Rows with NULL id or label are not used; an id
    labelled twice is toxic if one label says so; rows of ``docs`` that repeat an id all carry its label. NULL and empty texts take part as texts without words.
    Other columns are ignored, whatever their names.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    # At most max_rows pairs of numbers are broadcast, so one scan of the corpus finds the labelled texts; the passes below read only them.
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select("text", "_y"), "labelled")
    rows = stored(rows.groupBy("text").agg(F.max("_y").alias("_y")), "different")
    lexicon = {w: ("I", 0.5) for w in INSULTS} | {w: ("T", 1.0) for w in THREATS}
    for symbol, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("M", MODALS)):
        lexicon |= {w: (symbol, 1.0) for w in words}
    insults, openings = _learned(rows, lexicon)

    model = ToxicityModel(lexicon | insults, np.array([-3.0, 5.0, 8.0, 0.5, -0.5, 7.0, 0.5, 0.0, 1.0, 2.0, 0.0]), openings)
    tables = model.tables()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in pieces(batches, "text", PIECE_BYTES):
            x, _ = clause_features(batch.column(0), tables, machine)
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    # A few numbers for each labelled row come to the driver, max_rows rows at most.
    found = rows.mapInArrow(featured, "y int, x array<double>").groupBy("y", "x").count().orderBy("y", "x").collect()
    if found:
        model.weights = _fit(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]), np.array([r["count"] for r in found]), model.weights)
    return model


#: Toxic texts that an arc needs; standard errors and log likelihood ratio of its lower bound; continuations that make an opening.
LEAST_TEXTS, ERRORS, LEAST_RATIO, CONTINUATIONS = 4, 2.0, log(3), 5


def evidence(bad: float, good: float, toxic: int, clean: int) -> tuple[float, float]:
    """Log likelihood ratio of a word that ``bad`` of ``toxic`` and ``good`` of ``clean`` texts hold, and its lower bound."""
    ratio = log((bad + 0.5) / (toxic + 1)) - log((good + 0.5) / (clean + 1))
    return ratio, ratio - ERRORS * (1 / (bad + 0.5) + 1 / (good + 0.5)) ** 0.5


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole words of 3 characters or more (size 0), then openings of each size: which words, and where the form ends."""
    characters = _characters(data)
    yield 0, *_kept(np.where(_opening_ends(characters, starts, ends, 2) > 0, ends, -1))
    for size in OPENINGS:
        yield size, *_kept(_opening_ends(characters, starts, ends, size))


def _kept(stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.flatnonzero(stop > 0)
    return which, stop[which]


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of a batch hold each word and each opening."""
    for batch in pieces(batches, "text", PIECE_BYTES):
        data, at = text_bytes(batch.column(0))
        starts, ends, first = word_bounds(data, at, ALNUM)
        y = batch.column(1).to_numpy()
        text = np.repeat(np.arange(len(y)), np.diff(first))
        low = lowered(data).tobytes()
        for size, which, stop in _forms(data, starts, ends):
            h = word_hashes(data, starts[which], stop)
            _, once = np.unique(mix(h + text[which].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            _, a, back = np.unique(h[once], return_index=True, return_inverse=True)
            bad = np.bincount(back, weights=y[text[which[once]]], minlength=len(a)).astype(np.int64)
            good = np.bincount(back, minlength=len(a)) - bad
            spots = once[a]
            yield pa.RecordBatch.from_pydict({
                "size": pa.array(np.full(len(a), size, np.int32)), "form": pa.array([low[s:e].decode() for s, e in zip(starts[which[spots]].tolist(), stop[spots].tolist())], pa.string()),
                "bad": pa.array(bad, pa.int64()), "good": pa.array(good, pa.int64()),
            })


def _learned(rows: DataFrame, lexicon: dict[str, tuple[str, float]]) -> tuple[dict[str, tuple[str, float]], dict[str, float]]:
    """Insults and openings with their weights.

    A form's toxic evidence is the smaller of its texts and of the different (word before, word after) pairs around it, so that near copies do not
    make insults. It becomes an arc where the lower bound of its likelihood ratio is above 3, an opening only with 5 different words that begin with it.
    """
    totals = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counted = rows.mapInArrow(_text_counts, "size int, form string, bad long, good long").groupBy("size", "form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    bound = F.log(b / (toxic + 1)) - F.log(g / (clean + 1)) - ERRORS * F.sqrt(1 / b + 1 / g)
    seeds = [w for w, (s, _) in lexicon.items() if s == "I"]
    # The forms that stand out: their number follows the labelled rows, not the corpus.
    out = counted.where(((F.col("bad") >= LEAST_TEXTS) & (bound > LEAST_RATIO)) | ((F.col("size") == 0) & F.col("form").isin(seeds))).collect()
    if not out:
        return {}, {}
    tables = {}
    for size in {r["size"] for r in out}:
        own = [r["form"] for r in out if r["size"] == size]
        h, by = _hash_table(own)
        tables[size] = (h, [own[i] for i in by])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            data, at = text_bytes(batch.column(0))
            starts, ends, first = word_bounds(data, at, ALNUM)
            words = word_hashes(data, starts, ends)
            edge = np.zeros(1, np.uint64)
            before, after = np.concatenate([edge, words[:-1]])[: len(words)], np.concatenate([words[1:], edge])[: len(words)]
            before[first[:-1][np.diff(first) > 0]] = 0
            after[first[1:][np.diff(first) > 0] - 1] = 0
            near = mix(before * np.uint64(3) + mix(after)).view(np.int64)
            for size, which, stop in _forms(data, starts, ends):
                if size not in tables:
                    continue
                k, hit = _look_up(word_hashes(data, starts[which], stop), tables[size][0])
                spots = which[hit]
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array(np.full(len(spots), size, np.int32)), "form": pa.array([tables[size][1][i] for i in k[hit].tolist()], pa.string()),
                    "near": pa.array(near[spots], pa.int64()), "word": pa.array(words[spots].view(np.int64), pa.int64()),
                })

    seen = rows.where("_y = 1").mapInArrow(around, "size int, form string, near long, word long").groupBy("size", "form")
    spread = {(r["size"], r["form"]): (r["near"], r["words"]) for r in seen.agg(F.count_distinct("near").alias("near"), F.count_distinct("word").alias("words")).collect()}
    insults, openings = {}, {}
    for r in out:
        near, words = spread.get((r["size"], r["form"]), (0, 0))
        bad = min(r["bad"], near)
        ratio, low = evidence(bad, r["good"], toxic, clean)
        symbol = lexicon.get(r["form"], ("", 0.0))[0]
        if r["size"] == 0 and symbol == "I":
            if bad + r["good"] >= 10:
                insults[r["form"]] = ("I", min(1.0, max(0.0, ratio / 4)))
        elif bad >= LEAST_TEXTS and low > LEAST_RATIO:
            if r["size"] == 0 and not symbol:
                insults[r["form"]] = ("I", min(1.0, low / 4))
            elif r["size"] and words >= CONTINUATIONS:
                openings[r["form"]] = min(1.0, low / 4)
    return insults, openings


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, pulled towards ``prior``; the bias is pulled little."""
    x = np.column_stack([np.ones(len(x)), scaled(x)])
    pull = np.full(len(prior), strength)
    pull[0] = 0.01
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + pull * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, score (0 to 1), matched_clauses. Whole texts; NULL and empty texts have no clause and score lowest.
    Repeated rows are scored each; other columns are ignored."""
    tables = model.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in pieces(batches, "text", PIECE_BYTES):
            x, n = clause_features(batch.column(1), tables, machine)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(model.score(x)), "matched_clauses": pa.array(n, pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, matched_clauses long")
    return found.withColumnRenamed("id", id_col) if id_col != "id" else found


def without_toxic(docs: DataFrame, model: ToxicityModel, *, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``least``. NULL and empty texts stay; repeated rows are judged alike."""
    tables = model.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in pieces(batches, text_col, PIECE_BYTES):
            x, _ = clause_features(batch.column(batch.schema.get_field_index(text_col)), tables, machine)
            yield batch.filter(pa.array(model.score(x) < least))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
