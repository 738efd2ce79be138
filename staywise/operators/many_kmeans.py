"""Many k-means fits at once: every pass over the points moves the centres of all models.

A model is a number of clusters and a seed. All centres together form one small matrix that travels with the pass; each task sends sums per
centre, which are added up by Spark, so a pass costs one job whatever the number of models. Starts are chosen as in scalable k-means++: points
are sampled in proportion to their distance from the candidates so far, then the candidates, weighted by the points nearest to them,
are reduced to k on the driver. Random numbers come from a hash of the customer and the seed, so partitioning changes nothing.
"""
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

SAMPLING_ROUNDS = 2
ITERATIONS = 50
TOLERANCE = 1e-4
CELLS = 2_000_000  # distances held at once by a task


@dataclass
class Fit:
    """One fitted model; ``transform`` adds the number of the nearest centre."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = field(default=float("inf"))

    def transform(self, data, name="cluster"):
        return labelled(data, {name: self})


def _points(data):
    """The points as arrays with a number per customer for random draws."""
    return data.select(F.xxhash64("customer_id").alias("number"), vector_to_array("vector").alias("x"))


def _matrix(batch):
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _chunks(x, width):
    step = max(1, CELLS // max(width, 1))
    return (slice(at, at + step) for at in range(0, len(x), step))


def _distances(x, centres):
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


def _bounds(parts):
    return np.append(0, np.cumsum([len(p) for p in parts])).astype(int)


def _uniform(numbers, salts):
    """Numbers in (0, 1), one column per salt, from 64-bit keys."""
    x = numbers.astype(np.uint64)[:, None] ^ (salts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _sums(points, parts, width):
    """Per row of ``parts`` (centres of all models): points nearest to it within its model, their squared distances and coordinate sums."""
    centres, bounds = np.concatenate(parts), _bounds(parts)

    def run(batches):
        n, cost, total = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros((len(centres), width))
        for batch in batches:
            x = _matrix(batch)
            for rows in _chunks(x, len(centres)):
                part = x[rows]
                d = _distances(part, centres)
                owned = np.zeros(d.shape)
                at = np.arange(len(part))
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    owned[at, a + d[:, a:b].argmin(axis=1)] = 1.0
                n += owned.sum(axis=0)
                cost += (owned * d).sum(axis=0)
                total += owned.T @ part
        columns = [pa.array(np.arange(len(centres))), pa.array(n), pa.array(cost), *[pa.array(total[:, j]) for j in range(width)]]
        yield pa.record_batch(columns, names=["centre", "n", "cost", *[f"s{j}" for j in range(width)]])

    names = ["n", "cost", *[f"s{j}" for j in range(width)]]
    rows = points.mapInArrow(run, "centre long, " + ", ".join(f"{c} double" for c in names))
    found = np.zeros((len(centres), len(names)))
    for r in rows.groupBy("centre").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row per centre
        found[r["centre"]] = [r[c] for c in names]
    return found[:, 0], found[:, 1], found[:, 2:], bounds


def _first_points(points, seeds):
    """For every model the point with the smallest random number."""

    def run(batches):
        best = [(2.0, None)] * len(seeds)
        for batch in batches:
            x, u = _matrix(batch), _uniform(batch.column("number").to_numpy().view(np.uint64), seeds)
            if not len(x):
                continue
            at = u.argmin(axis=0)
            best = [min(old, (u[i, m], x[i].tolist()), key=lambda e: e[0]) for m, (old, i) in enumerate(zip(best, at, strict=True))]
        known = [(m, u, x) for m, (u, x) in enumerate(best) if x is not None]
        columns = [pa.array([e[k] for e in known], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.list_(pa.float64())))]
        yield pa.record_batch(columns, names=["model", "u", "x"])

    rows = points.mapInArrow(run, "model long, u double, x array<double>").groupBy("model").agg(F.min_by("x", "u").alias("x")).collect()
    return [np.array([r["x"]]) for r in sorted(rows, key=lambda r: r["model"])]


def _sampled(points, candidates, seeds, expected, cost):
    """More candidates of every model: points drawn with probability ``expected`` times their share of the cost."""
    centres, bounds = np.concatenate(candidates), _bounds(candidates)

    def run(batches):
        for batch in batches:
            x, numbers = _matrix(batch), batch.column("number").to_numpy().view(np.uint64)
            models, drawn = [], []
            for rows in _chunks(x, len(centres)):
                d = _distances(x[rows], centres)
                u = _uniform(numbers[rows], seeds)
                for m, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if cost[m] > 0:
                        hit = np.flatnonzero(u[:, m] < expected[m] * d[:, a:b].min(axis=1) / cost[m])
                        models += [m] * len(hit)
                        drawn += x[rows][hit].tolist()
            yield pa.record_batch([pa.array(models, pa.int64()), pa.array(drawn, pa.list_(pa.float64()))], names=["model", "x"])

    more = [[] for _ in candidates]
    for r in points.mapInArrow(run, "model long, x array<double>").collect():  # about twice k rows per model
        more[r["model"]].append(r["x"])
    return [np.concatenate([c, np.array(sorted(m))]) if m else c for c, m in zip(candidates, more, strict=True)]


def _reduced(candidates, weights, k, seed):
    """k starting centres from weighted candidates: drawn by weighted distance, then moved a few times among the candidates."""
    rng = np.random.default_rng(seed)
    weights = np.maximum(weights, 1e-9)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        pull = weights * _distances(candidates, candidates[chosen]).min(axis=1)
        chosen.append(int(rng.choice(len(candidates), p=pull / pull.sum())) if pull.sum() > 0 else chosen[-1])
    centres = candidates[chosen].copy()
    for _ in range(30):
        near = _distances(candidates, centres).argmin(axis=1)
        moved = centres.copy()
        for c in range(k):
            own = near == c
            if own.any():
                moved[c] = np.average(candidates[own], axis=0, weights=weights[own])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _starts(points, models, width):
    seeds = np.array([seed * 1000 + k for k, seed in models], np.int64)
    candidates = _first_points(points, seeds)
    per_model = lambda values, bounds: np.add.reduceat(values, bounds[:-1])
    expected = np.array([2.0 * k for k, _ in models])
    for step in range(SAMPLING_ROUNDS):
        _, cost, _, bounds = _sums(points, candidates, width)
        candidates = _sampled(points, candidates, seeds + 7_919 * (step + 1), expected, per_model(cost, bounds))
    n, _, _, bounds = _sums(points, candidates, width)
    return [_reduced(c, n[a:b], k, seed) for c, a, b, (k, seed) in zip(candidates, bounds[:-1], bounds[1:], models, strict=True)]


def fit_many(data, models, iterations=ITERATIONS, tolerance=TOLERANCE):
    """Fits of all ``models``, a list of (k, seed). Models whose centres have come to rest leave the passes."""
    points = _points(data).persist()
    try:
        first = points.select("x").first()
        if first is None:
            raise ValueError("no points to cluster")
        width = len(first["x"])
        fits = [Fit(k, seed, start) for (k, seed), start in zip(models, _starts(points, models, width), strict=True)]
        moving = list(fits)
        for _ in range(iterations):
            n, _, total, bounds = _sums(points, [f.centres for f in moving], width)
            still = []
            for f, a, b in zip(moving, bounds[:-1], bounds[1:], strict=True):
                filled = n[a:b] > 0  # an empty cluster stays where it is
                moved = f.centres.copy()
                moved[filled] = total[a:b][filled] / n[a:b][filled, None]
                far = ((moved - f.centres) ** 2).sum(axis=1).max() > tolerance**2
                f.centres = moved
                if far:
                    still.append(f)
            moving = still
            if not moving:
                break
        _, cost, _, bounds = _sums(points, [f.centres for f in fits], width)
        for f, value in zip(fits, np.add.reduceat(cost, bounds[:-1]), strict=True):
            f.cost = float(value)
        return fits
    finally:
        points.unpersist()


def best_fits(fits):
    """The cheapest fit of every k."""
    best = {}
    for f in fits:
        if f.k not in best or f.cost < best[f.k].cost:
            best[f.k] = f
    return [best[k] for k in sorted(best)]


def labelled(data, fits):
    """``data`` with the nearest centre of each of ``fits`` (name: fit) as a column, without another scan per model."""
    x = vector_to_array("vector")
    for name, fit in fits.items():
        parts = [
            F.struct(sum((x[j] - F.lit(float(v))) * (x[j] - F.lit(float(v))) for j, v in enumerate(centre)).alias("d"), F.lit(c).alias("c"))
            for c, centre in enumerate(fit.centres)
        ]
        data = data.withColumn(name, (F.least(*parts) if len(parts) > 1 else parts[0])["c"])
    return data


def silhouettes(data, fits):
    """Mean silhouette (squared distances) of each fit, in one pass after one pass for the clusters' sums.

    The mean squared distance from a point to a cluster follows from the cluster's size, coordinate sum and sum of squares.
    """
    points = _points(data)
    width = fits[0].centres.shape[1]
    centres = np.concatenate([f.centres for f in fits])
    n, cost, total, bounds = _sums(points, [f.centres for f in fits], width)
    # squared norms: around the centre, cost = sum |x|^2 - 2 c.sum x + n |c|^2
    squares = cost + 2.0 * (centres * total).sum(axis=1) - n * (centres * centres).sum(axis=1)

    def run(batches):
        score, rows_seen = np.zeros(len(fits)), 0
        for batch in batches:
            x = _matrix(batch)
            rows_seen += len(x)
            for rows in _chunks(x, len(centres)):
                part = x[rows]
                norm, d = (part * part).sum(axis=1), _distances(part, centres)
                far = n[None, :] * norm[:, None] + squares[None, :] - 2.0 * (part @ total.T)  # summed over the cluster
                for m, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own = d[:, a:b].argmin(axis=1)
                    at = np.arange(len(part))
                    inside = far[:, a:b][at, own] / np.maximum(n[a:b][own] - 1, 1)
                    other = far[:, a:b] / np.maximum(n[a:b], 1)[None, :]
                    other[:, n[a:b] == 0] = np.inf
                    other[at, own] = np.inf
                    outside = other.min(axis=1)
                    alone = (n[a:b][own] <= 1) | ~np.isfinite(outside)
                    widest = np.where(alone, 1.0, np.maximum(np.maximum(inside, outside), 1e-300))
                    score[m] += np.where(alone, 0.0, (outside - inside) / widest).sum()
        yield pa.record_batch([pa.array(np.arange(len(fits))), pa.array(score), pa.array(np.full(len(fits), rows_seen))], names=["m", "s", "n"])

    rows = points.mapInArrow(run, "m long, s double, n long").groupBy("m").agg((F.sum("s") / F.sum("n")).alias("mean")).collect()
    return [r["mean"] for r in sorted(rows, key=lambda r: r["m"])]
