"""Mixing by soft membership: document rates that bring expected domain token totals to target weights."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored
from .words import SPACES, pieces, text_bytes, word_bounds, word_hashes

PIECE_BYTES = 2 << 20
_N_FEATURES = 256 + 5


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, features) and words per text: square roots of byte frequencies, length, word length, repeats, distinct words."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at, ~SPACES)
    n_words = np.diff(first)
    x = np.zeros((len(column), _N_FEATURES))
    hashes = word_hashes(data, starts, ends)
    again = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        again[2:] = np.cumsum(hashes[1:] == hashes[:-1])
        again[1] = 0
    for i, (lo, hi, a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), first[:-1].tolist(), first[1:].tolist())):
        if hi == lo:
            continue
        x[i, :256] = np.sqrt(np.bincount(data[lo:hi], minlength=256) / (hi - lo))
        if b > a:
            n = b - a
            x[i, 257] = (ends[a:b] - starts[a:b]).mean() / 10
            x[i, 258] = (again[b] - again[a + 1]) / n
            x[i, 259] = len(np.unique(hashes[a:b])) / n
        x[i, 256] = np.log1p(hi - lo) / 10
        x[i, 260] = 1.0
    return x, n_words


@dataclass
class DomainModel:
    """Softmax regression over :func:`text_features`, trained on labelled rows."""

    domains: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


@dataclass
class Mixture:
    """A fitted mixture: how rates follow from posteriors, and what they reach."""

    model: DomainModel
    least: float
    moves: list[np.ndarray] = field(default_factory=list)
    natural: np.ndarray | None = None
    target: np.ndarray | None = None
    reached: np.ndarray | None = None
    rounds: int = 0

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Each gradient step moved a document's rate by its posteriors times one vector; then came the projection."""
        r = np.ones(len(p))
        for move in self.moves:
            r = np.maximum(self.least, r - p @ move)
        return r


def fit_domains(
    docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 5_000
) -> DomainModel:
    """Train on the first ``max_rows`` labelled rows by a hash of the id; their features, some MB, come to the driver.

    Rows with NULL id or label are not used; an id labelled twice has its largest label; rows of ``docs`` that repeat an id all carry its
    label; NULL and empty texts have features of zeros. Without labels there is one domain, NULL. Other columns are ignored."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("string")).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            x, _ = text_features(batch.column(1))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "y": batch.column(2), "x": pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())})

    found = rows.select("_id", "text", "_y").mapInArrow(featured, f"id {docs.schema[id_col].dataType.simpleString()}, y string, x binary").toArrow().to_pydict()
    order = sorted(range(len(found["y"])), key=lambda i: (found["id"][i], found["x"][i]))
    domains = sorted(set(found["y"]))
    if not domains:
        return DomainModel([None], np.zeros(_N_FEATURES), np.ones(_N_FEATURES), np.zeros((_N_FEATURES + 1, 1)))
    x = np.array([np.frombuffer(found["x"][i], "<f4") for i in order], dtype=np.float64)
    y = np.array([domains.index(found["y"][i]) for i in order])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    return DomainModel(domains, mean, scale, _softmax_fit(z, np.eye(len(domains))[y]))


def _softmax_fit(z: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Accelerated gradient descent on the mean log loss."""
    w = ahead = np.zeros((z.shape[1], y.shape[1]))
    step = 1.0 / (0.5 * float(np.linalg.eigvalsh(z.T @ z / len(z))[-1]) + ridge)
    for t in range(rounds):
        p = np.exp((s := z @ ahead) - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (z.T @ (p - y) / len(z) + ridge * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


def memberships(docs: DataFrame, model: DomainModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens (words between ASCII white space), posteriors (in the order of ``model.domains``).

    Repeated rows and NULL ids are rows of their own; NULL and empty texts have no tokens. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            x, n = text_features(batch.column(1))
            p = model.posteriors(x)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "posteriors": pa.array(p.tolist(), pa.list_(pa.float64()))})

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, posteriors array<double>")
    return found.withColumnRenamed("id", id_col) if id_col != "id" else found


def fit_rates(
    members: DataFrame, model: DomainModel, weights: dict, *, least: float = 0.0, headroom: float | None = None, rounds: int = 200,
    tolerance: float = 1e-6, gap: float = 1e-3, strict: bool = True,
) -> Mixture:
    """Rates r >= ``least`` that minimise the squared distance of expected domain tokens from ``weights`` times a total.

    ``weights`` gives each domain's share (missing: 0; they are scaled to 1). The total is the corpus' own tokens, or, with ``headroom``, that
    multiple of the least total at which no domain has to shrink. In the metric that counts each document by its tokens, the gradient of a rate is
    posteriors . residual, so a step is one vector of as many numbers as domains; each round is one distributed sum of
    that many numbers over ``members``. Steps have Barzilai-Borwein length. Every 8 rounds the rates are
    written out, which keeps expressions short. Rounds end when every domain is within ``tolerance`` of its target (both as parts of the
    corpus' tokens); if after ``rounds`` one is further than ``gap`` from it, the target is out of reach: ValueError says by how much, or, not
    ``strict``, a warning does and the nearest rates found are the result.
    No documents or no tokens: every rate stays 1. Rows that repeat count each; NULL texts have no tokens.
    """
    d = len(model.domains)
    p = [F.col("posteriors")[k] for k in range(d)]
    total = members.agg(F.sum("n_tokens").alias("t"), *[F.sum(F.col("n_tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(d)]).first()
    mix = Mixture(model, least)
    if not total["t"]:
        return mix
    t = float(total["t"])
    gram = np.array([[total[f"m{i}_{j}"] / t for j in range(d)] for i in range(d)])
    low, high = np.linalg.eigvalsh(gram)[[0, -1]]
    share = np.array([float(weights.get(x, 0.0)) for x in model.domains])
    share = share / share.sum() if share.sum() > 0 else np.full(d, 1 / d)
    state = members.select("n_tokens", "posteriors", F.lit(1.0).alias("rate"))
    step = 1 / high
    before = written = None
    while True:
        sums = state.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * p[i]).alias(f"s{i}") for i in range(d)]).first()
        reached = np.array([sums[f"s{i}"] for i in range(d)]) / t
        if mix.natural is None:
            mix.natural = reached
            want = share > 0
            mix.target = share * (headroom * float((reached[want] / share[want]).max()) if headroom else 1.0)
        mix.reached = reached
        residual = reached - mix.target
        if np.abs(residual).max() < tolerance or mix.rounds == rounds:
            break
        if before is not None and (change := float(((residual - before) ** 2).sum())) > 0:
            step = float(np.clip(step**2 * (before @ gram @ before) / change, 1 / high, 1 / max(low, high * 1e-3)))
        move = step * residual
        mix.moves.append(move)
        mix.rounds += 1
        before = residual
        dot = sum((p[i] * float(move[i]) for i in range(1, d)), p[0] * float(move[0]))
        state = state.select("n_tokens", "posteriors", F.greatest(F.lit(float(least)), F.col("rate") - dot).alias("rate"))
        if mix.rounds % 8 == 0:
            state = stored(state, "rates")
            if written is not None:
                drop(written)
            written = state
    if written is not None:
        drop(written)
    if (far := float(np.abs(residual).max())) > gap:
        said = f"the target {mix.target.round(4).tolist()} is out of reach: {far:.4f} of all tokens off after {mix.rounds} rounds"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return mix


def mixed_rates(members: DataFrame, mix: Mixture, *, id_col: str = "doc_id") -> DataFrame:
    """``members`` with each document's ``rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mix.model.domains)
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix.rates(p), pa.float64())], names=[*batch.schema.names, "rate"])

    kind = members.schema[id_col].dataType.simpleString()
    return members.select(id_col, "n_tokens", "posteriors").mapInArrow(run, f"{id_col} {kind}, n_tokens long, posteriors array<double>, rate double")


def mixed(docs: DataFrame, mix: Mixture, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says: the whole part, and once more with the
    fraction's chance, by a seeded hash of id and text. Rates below 1 may drop rows; rates of 1 and more never do. Equal rows draw alike, so they
    are repeated equally often. NULL and empty texts have rates of their own like others; columns may have any name."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, PIECE_BYTES):
            x, _ = text_features(batch.column(batch.schema.get_field_index(text_col)))
            rates = pa.array(mix.rates(mix.model.posteriors(x)))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, names=names), rates], names=["row", "rate"])

    rated = docs.mapInArrow(run, f"row struct<{kinds.replace('` ', '`: ')}>, rate double")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("row")[id_col], F.col("row")[text_col]), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    # A row of no copies has an empty sequence and goes.
    again = rated.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return again.select("row.*")
