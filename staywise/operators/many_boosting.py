"""Many boosted tree models at once: every pass over the rows serves all points of a grid.

The trees are those of Spark's ``GBTClassifier``: variance splits on at most 64 bins, the first tree on the labels, later ones on the
gradients of the log-loss, stopping by the held-out rows. Rows are binned once into blocks of bytes. A pass sends each task's sums per node, feature
and bin, which Spark adds up, and the driver chooses the splits, so a round costs as many jobs as its trees have levels, whatever the number
of models. Of two children only the smaller one is summed, the other is the rest of its parent. Models that have made the same choices so far
(as points that differ in the smallest leaf often do) share their margins and sums until they part.
"""
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from ..session import remove, staged_path

BINS = 64
SPLIT_ROWS = 10_000  # rows from which the bins' edges are taken, as many as Spark's trees take
ROWS_PER_BLOCK = 400_000
KEPT_EVERY = 25  # rounds after which margins are written, so that lineage stays short
FEW_BLOCKS = 32


@dataclass
class Tree:
    """Nodes are numbered from 1, the children of n are 2n and 2n + 1. ``splits``: (feature, last bin of the left side, gain)."""

    splits: dict = field(default_factory=dict)
    nodes: dict = field(default_factory=dict)  # (rows, sum)

    def value(self, node):
        rows, total = self.nodes[node]
        return total / rows


@dataclass
class Boosted:
    """The trees of one grid point; ``model`` makes them an ordinary fitted pipeline."""

    prepared: list
    edges: list
    rate: float
    trees: list = field(default_factory=list)
    kept: int = 1
    error: float = float("nan")

    @property
    def weights(self):
        return [1.0 if i == 0 else self.rate for i in range(self.kept)]

    def model(self, spark):
        return PipelineModel([*self.prepared, _spark_model(spark, self.trees[: self.kept], self.weights, self.edges)])


# --- rows ------------------------------------------------------------------------------------------------------------


def bin_edges(values, most):
    """Edges between the distinct values, at most ``most`` of them, about equally many rows apart."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) - 1 <= most:
        return (distinct[:-1] + distinct[1:]) / 2.0
    stride, edges = len(values) / (most + 1), []
    seen, target = np.cumsum(counts), len(values) / (most + 1)
    for i in range(1, len(distinct)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            edges.append((distinct[i - 1] + distinct[i]) / 2.0)
            target += stride
    return np.array(edges)


def _edges(fitted, columns, n, seed):
    share = F.pmod(F.xxhash64("cutoff", "customer_id", F.lit(seed)), F.lit(1_000_000)) if "cutoff" in fitted.columns else F.rand(seed) * 1_000_000
    some = fitted.where(share < 1_000_000 * SPLIT_ROWS / n) if n > SPLIT_ROWS else fitted
    table = some.select(*columns).toArrow()
    return [bin_edges(table.column(c).to_numpy(), min(BINS, n) - 1) for c in columns]


def _binned(batch, columns, edges):
    return np.stack([np.searchsorted(e, batch.column(c).to_numpy(zero_copy_only=False)).astype(np.uint8) for c, e in zip(columns, edges, strict=True)])


def _blocks(rows, columns, edges, target, n):
    """RDD of (bins per column, label -1 or 1, number of rows to fit on, margins): rows to fit on stand first."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-n // (ROWS_PER_BLOCK * cores)))  # every wave is full
    keys = [c for c in ("customer_id", "cutoff") if c in rows.columns]

    def pack(batches):
        parts = [(_binned(b, columns, edges), b.column("y").to_numpy(zero_copy_only=False), b.column("held_out").to_numpy(zero_copy_only=False)) for b in batches if len(b)]
        if parts:
            bins, y, held = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
            order = np.argsort(held, kind="stable")
            block = np.ascontiguousarray(bins[:, order]), 2.0 * y[order] - 1.0, int((~held.astype(bool)).sum()), np.zeros((1, len(y)))
            yield pa.record_batch([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    dealt = rows.repartition(tasks, *keys) if keys else rows.repartition(tasks)
    chosen = dealt.select(*columns, F.col(target).cast("double").alias("y"), "held_out")
    return chosen.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _placed(bins, tree):
    """(node, its rows) for the nodes without a split; None stands for all rows."""
    open_nodes = [(1, None)]
    while open_nodes:
        node, rows = open_nodes.pop()
        if node not in tree.splits:
            yield node, rows
            continue
        column, last, _ = tree.splits[node]
        low = (bins[column] if rows is None else bins[column][rows]) <= last
        sides = (np.flatnonzero(low), np.flatnonzero(~low)) if rows is None else (rows[low], rows[~low])
        open_nodes += [(2 * node, sides[0]), (2 * node + 1, sides[1])]


def _paid(bins, tree):
    out = np.empty(bins.shape[1])
    for node, rows in _placed(bins, tree):
        out[slice(None) if rows is None else rows] = tree.value(node)
    return out


def _margins(bins, trees, weights):
    return sum((w * _paid(bins, t) for w, t in zip(weights, trees, strict=True)), np.zeros(bins.shape[1]))


def _gradients(y, margins):
    return 4.0 * y / (1.0 + np.exp(2.0 * y * margins))


def _sums(block, wanted, first):
    """Rows and gradients per wanted node, column and bin. ``wanted``: (slot of margins, tree, nodes)."""
    bins, y, n, margins = block
    bins, y = bins[:, :n], y[:n]
    out = np.zeros((sum(len(nodes) for _, _, nodes in wanted), 2, len(bins), BINS))
    at, known, whole = 0, {}, {}
    for slot, tree, nodes in wanted:
        if slot not in known:
            known[slot] = y if first else _gradients(y, margins[slot, :n])
        places = {node: at + i for i, node in enumerate(nodes)}
        at += len(nodes)
        for node, rows in _placed(bins, tree):
            if node in places and rows is None:
                whole[places[node]] = known[slot]
            elif node in places:
                weights = known[slot][rows]
                for j, column in enumerate(bins):
                    codes = column[rows].astype(np.intp)
                    out[places[node], 0, j] = np.bincount(codes, minlength=BINS)
                    out[places[node], 1, j] = np.bincount(codes, weights, minlength=BINS)
    for j, column in enumerate(bins if whole else ()):
        codes = column.astype(np.intp)
        out[list(whole), 0, j] = np.bincount(codes, minlength=BINS)
        for place, weights in whole.items():
            out[place, 1, j] = np.bincount(codes, weights, minlength=BINS)
    return out


def _moved(block, steps):
    """The block with new margins: of each (slot, tree, weight)."""
    bins, y, n, margins = block
    return bins, y, n, np.stack([margins[slot] + weight * _paid(bins, tree) for slot, tree, weight in steps])


def _held_out_loss(block):
    _, y, n, margins = block
    return np.append(np.logaddexp(0.0, -2.0 * y[n:] * margins[:, n:]).sum(axis=1), len(y) - n)


def _added(blocks, function):
    """Sum over the blocks of the tuple of arrays that ``function`` gives."""
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    found = blocks.map(function)
    return found.reduce(add) if blocks.getNumPartitions() <= FEW_BLOCKS else found.treeReduce(add)


# --- trees -----------------------------------------------------------------------------------------------------------


@dataclass
class _Branch:
    """A tree in the making, shared by the ``members`` that have chosen the same splits; ``sums`` of its open nodes."""

    slot: int
    tree: Tree
    members: tuple
    sums: dict = field(default_factory=dict)


def _best_split(sums, n_edges, smallest):
    """(column, last bin on the left, gain, (rows, sum) left, right) or None."""
    below = sums.cumsum(axis=-1)[:, :, :-1]
    rows, total = sums[0, 0].sum(), sums[1, 0].sum()
    left_rows, left = below
    right_rows, right = rows - left_rows, total - left
    allowed = (left_rows >= max(smallest, 1)) & (right_rows >= max(smallest, 1)) & (np.arange(BINS - 1) < n_edges[:, None])
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, left * left / left_rows + right * right / right_rows - total * total / rows, -np.inf)
    j, last = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[j, last] > 1e-12 * total * total / rows:
        return None
    sides = [(int(a[j, last]), float(b[j, last])) for a, b in ((left_rows, left), (right_rows, right))]
    return int(j), int(last), float(gain[j, last] / rows), *sides


def _grown(branch, depth_of, leaf_of, level, n_edges):
    """The branch after one more level, parted where its members choose differently: (ended, still growing)."""
    ended, ways = [], {}
    stop = tuple(m for m in branch.members if depth_of[m] <= level)
    if stop:
        ended.append(_Branch(branch.slot, branch.tree, stop))
    by_leaf = {}
    for m in branch.members:
        if m not in stop:
            by_leaf.setdefault(leaf_of[m], []).append(m)
    for leaf, members in by_leaf.items():
        chosen = {node: _best_split(sums, n_edges, leaf) for node, sums in branch.sums.items()}
        key = tuple((node, c[:2]) for node, c in sorted(chosen.items()) if c)
        ways.setdefault(key, ({node: c for node, c in chosen.items() if c}, []))[1].extend(members)
    growing = []
    for chosen, members in ways.values():
        tree = Tree(dict(branch.tree.splits), dict(branch.tree.nodes))
        for node, (column, last, gain, left, right) in chosen.items():
            tree.splits[node] = column, last, gain
            tree.nodes[2 * node], tree.nodes[2 * node + 1] = left, right
        (growing if chosen else ended).append(_Branch(branch.slot, tree, tuple(members), {node: branch.sums[node] for node in chosen}))
    return ended, growing


def _fitted_round(blocks, branches, depth_of, leaf_of, n_edges, first):
    """Grows the trees of one round, level by level; the branches at their end."""
    ended, level = [], 0
    while branches:
        parts = [_grown(b, depth_of, leaf_of, level, n_edges) for b in branches]
        ended += [b for e, _ in parts for b in e]
        branches = [b for _, g in parts for b in g]
        level += 1
        ended += [b for b in branches if max(depth_of[m] for m in b.members) <= level]
        branches = [b for b in branches if max(depth_of[m] for m in b.members) > level]
        if not branches:
            break
        wanted = [(b.slot, b.tree, [min((2 * p, 2 * p + 1), key=lambda c, b=b: b.tree.nodes[c][0]) for p in b.sums]) for b in branches]
        sums, at = _added(blocks, lambda block: (_sums(block, wanted, first),))[0], 0
        for b, (_, _, nodes) in zip(branches, wanted, strict=True):
            children = {}
            for parent, node in zip(b.sums, nodes, strict=True):
                children[node], children[node ^ 1] = sums[at], b.sums[parent] - sums[at]
                at += 1
            b.sums = children
    return ended


def fit_grid(train, pipeline, grid, rounds, target):
    """A ``Boosted`` for every (rate, depth, leaf) of ``grid``; the stages of ``pipeline`` give the inputs and the seed of the rows for the edges."""
    spark, (prepare, assembler, classifier) = train.sparkSession, pipeline.getStages()
    columns = assembler.getInputCols()
    rows = prepare.transform(train)
    fitted = rows.where("NOT held_out")
    n = fitted.count()
    edges = _edges(fitted, columns, n, classifier.getSeed())
    n_edges = np.array([len(e) for e in edges])
    models = [Boosted([prepare, assembler], edges, rate) for rate, _, _ in grid]
    depth_of, leaf_of = [d for _, d, _ in grid], [leaf for _, _, leaf in grid]
    blocks = _blocks(rows, columns, edges, target, n).persist(StorageLevel.MEMORY_AND_DISK_DESER)  # pickled already: written again by Java and packed, they only cost time
    slots, kept = {0: tuple(range(len(grid)))}, None
    roots, losses = _added(blocks, lambda b: (_sums(b, [(0, Tree(), [1])], True), _held_out_loss(b)))
    for done in range(rounds):
        branches = [
            _Branch(slot, Tree(nodes={1: (int(roots[i, 0, 0].sum()), float(roots[i, 1, 0].sum()))}), members, {1: roots[i]})
            for i, (slot, members) in enumerate(slots.items())
        ]
        ended = _fitted_round(blocks, branches, depth_of, leaf_of, n_edges, done == 0)
        steps, followers = [], []
        for branch in ended:
            for weight in sorted({models[m].rate if done else 1.0 for m in branch.members}):
                members = tuple(m for m in branch.members if not done or models[m].rate == weight)
                steps.append((branch.slot, branch.tree, weight))
                followers.append(members)
                for m in members:
                    models[m].trees.append(branch.tree)
        before, old = blocks, kept
        blocks = before.map(lambda b, steps=steps: _moved(b, steps))
        if (done + 1) % KEPT_EVERY == 0:
            kept = staged_path(spark, "margins")
            blocks.saveAsPickleFile(kept, 1)
            blocks = spark.sparkContext.pickleFile(kept)
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)  # pickled already: written again by Java and packed, they only cost time
        wanted = [(slot, Tree(), [1]) for slot in range(len(steps))]
        roots, losses = _added(blocks, lambda b: (_sums(b, wanted, False), _held_out_loss(b)))
        before.unpersist()
        if old and old != kept:
            remove(spark, old)
        slots = {}
        for slot, members in enumerate(followers):
            going = tuple(m for m in members if _goes_on(models[m], done, losses[slot] / losses[-1] if losses[-1] else float("nan")))
            if going:
                slots[slot] = going
        roots = roots[list(slots)]
        if not slots:
            break
    blocks.unpersist()
    if kept:
        remove(spark, kept)
    return models


def _goes_on(model, done, error):
    """Whether the held-out error has not risen; the number of trees with the least error is kept."""
    if done == 0:
        model.error = error
        return True
    if model.error - error < 0.0:
        return False
    if error < model.error:
        model.error, model.kept = error, done + 1
    return True


def scores(models, prepared, columns, target):
    """``y`` and one probability per model (``p0``, ``p1`` ...) of the rows, in one pass."""
    edges, names = models[0].edges, [f"p{i}" for i in range(len(models))]
    shared = prepared.sparkSession.sparkContext.broadcast([(m.trees[: m.kept], m.weights) for m in models])

    def score(batches):
        for batch in batches:
            bins = _binned(batch, columns, edges)
            found = [pa.array(1.0 / (1.0 + np.exp(-2.0 * _margins(bins, *m)))) for m in shared.value]
            yield pa.record_batch([batch.column("y"), *found], names=["y", *names])

    given = prepared.select(*columns, F.col(target).cast("int").alias("y"))
    return given.mapInArrow(score, "y int, " + ", ".join(f"{c} double" for c in names))


def _spark_model(spark, trees, weights, edges):
    """The trees as Spark's own model class. Impurities are not known here (NaN); gains, rows and values are."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    tree_classes, unknown = jvm.org.apache.spark.ml.tree, float("nan")

    def node(tree, at):
        rows, total = tree.nodes[at]
        stats = gateway.new_array(jvm.double, 3)
        stats[0], stats[1], stats[2] = float(rows), total, unknown
        calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, rows)
        if at not in tree.splits:
            return tree_classes.LeafNode(total / rows, unknown, calculator)
        column, last, gain = tree.splits[at]
        split = tree_classes.ContinuousSplit(column, float(edges[column][last]))
        return tree_classes.InternalNode(total / rows, unknown, gain, node(tree, 2 * at), node(tree, 2 * at + 1), split, calculator)

    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    made, weighted = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        made[i] = kind(f"tree_{i}", node(tree, 1), len(edges))
        weighted[i] = weight
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("GBTClassifier")
    model = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, made, weighted, len(edges), 2))
    model._resetUid(uid)
    return model.setFeaturesCol("inputs")
