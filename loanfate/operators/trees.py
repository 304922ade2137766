"""Gradient-boosted regression trees of several targets, grown side by side over small binned rows.

The trees are those of :class:`pyspark.ml.regression.GBTRegressor` with its defaults: thresholds between
the quantiles of a sample (the same rows for the same seed), variance as impurity, a first tree of
weight one and later ones, of the squared error's gradient, of a tenth. Spark's own keeps an object of some
200 bytes for each row and target, which beyond the executors' memory is read back from disk at every
pass. Here a row is a byte per input column and a double per target, in blocks on the shared folder, and a
pass over it serves one level of the trees of all targets.
"""

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanfate.sources import dropped, scratch_path, shuffles_freed

#: Those of GBTRegressor: bins of a numeric input, rows sampled for them at least, weight of later trees, and what counts as no impurity.
BINS, SAMPLE, STEP, LEAST_IMPURITY = 32, 10_000, 0.1, 2.220446049250313e-16
#: Blocks that Spark hands Python at a time.
BLOCKS_AT_ONCE = 16


@dataclass(frozen=True)
class Inputs:
    """The columns of binned rows: numeric ones with their thresholds, then indexed categories with their number of levels."""

    numeric: list[str]
    categories: list[str]
    thresholds: list[np.ndarray]
    levels: list[int]

    @property
    def widths(self) -> list[int]:
        """Values that each column can have; a level beyond those of the training rows is the last."""
        return [len(t) + 1 for t in self.thresholds] + [n + 1 for n in self.levels]

    def binned(self, columns: list[pa.Array]) -> np.ndarray:
        """A row for each column, whose values are numbers of bins or levels."""
        kind = np.uint8 if max(self.widths, default=0) <= 256 else np.int32
        rows = np.empty((len(self.widths), len(columns[0]) if columns else 0), kind)
        for k, (column, width) in enumerate(zip(columns, self.widths)):
            values = column.to_numpy(zero_copy_only=False).astype(float)
            if np.isnan(values).any():
                raise ValueError(f"null or NaN in {(self.numeric + self.categories)[k]}")
            if k < len(self.numeric):
                rows[k] = np.searchsorted(self.thresholds[k], values)
            else:
                rows[k] = np.where((values >= 0) & (values < width - 1), values, width - 1)
        return rows


@dataclass
class Tree:
    """Nodes as in a heap: 2k + 1 and 2k + 2 are below k. ``right`` says for each value of a node's column whether it goes right."""

    column: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, width: int) -> "Tree":
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros((n, width), bool), np.zeros(n))

    def nodes(self, rows: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels, or the leaf above."""
        node, place = np.zeros(rows.shape[1], np.intp), np.arange(rows.shape[1])
        for _ in range(levels):
            column = self.column[node]
            below = 2 * node + 1 + self.right[node, rows[column, place]]
            node = np.where(column < 0, node, below)
        return node


@dataclass(frozen=True)
class BoostedTargets:
    """Boosted trees of several targets on shared inputs."""

    inputs: Inputs
    depth: int
    trees: dict[str, list[Tree]]

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.inputs, self.depth, list(self.trees.values())))
        names = [f"{t}Pred" for t in self.trees]

        def predict(*columns: pa.Array) -> pa.Array:
            inputs, depth, trees = shared.value
            rows = inputs.binned(columns)
            found = []
            for of_target in trees:
                values = [tree.value[tree.nodes(rows, depth)] for tree in of_target]
                found.append(pa.array(sum((STEP * v for v in values[1:]), values[0])))
            return pa.StructArray.from_arrays(found, names)

        columns = [F.col(c).cast("double") for c in self.inputs.numeric + self.inputs.categories]
        made = F.arrow_udf(predict, ", ".join(f"`{c}` double" for c in names))(*columns)
        return df.withColumn("_made", made).withColumns({c: F.col(f"_made.`{c}`") for c in names}).drop("_made")


@contextmanager
def _few_at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Statements run inside hand Python at most so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quantile_thresholds(values: np.ndarray, expected: float) -> np.ndarray:
    """At most ``BINS`` - 1 thresholds midway between sampled values, as GBTRegressor finds them.

    It counts the zeros as what the other values lack of the ``expected`` number of sampled rows.
    """
    value, n = np.unique(values[values != 0], return_counts=True)
    n = n.astype(float)
    if len(value) and expected - n.sum() > LEAST_IMPURITY * n.sum() * 100:
        at = np.searchsorted(value, 0.0)
        value, n = np.insert(value, at, 0.0), np.insert(n, at, expected - n.sum())
    middle = (value[:-1] + value[1:]) / 2
    if len(value) <= BINS:
        return middle
    stride = expected / BINS
    found, before, target = [], n[0], stride
    for k in range(1, len(value)):
        now = before + n[k]
        if abs(before - target) < abs(now - target):
            found.append(middle[k - 1])
            target += stride
        before = now
    return np.array(found)


def _inputs(train: DataFrame, numeric: list[str], categories: list[str], levels: list[int], seed: int) -> Inputs:
    """Thresholds by a sample of the rows, bounded whatever their number."""
    spark, n = train.sparkSession, train.count()
    rows = train.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(numeric)])
    share = SAMPLE / n if n > SAMPLE else 1.0
    if numeric and share < 1:
        # The rows that GBTRegressor takes.
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sampled = rows._jdf.toJavaRDD().sample(False, share, draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(sampled, rows._jdf.schema()), spark)
    table = rows.toArrow() if numeric else None
    values = [table.column(k).to_numpy().astype(float) for k in range(len(numeric))]
    return Inputs(numeric, categories, [quantile_thresholds(v, share * n) for v in values], levels)


def _best_split(n: np.ndarray, s: np.ndarray, inputs: Inputs) -> tuple[int, np.ndarray, float, float] | None:
    """The column, the values that go right, and the left and right means of the split that gains most, from each value's rows and sum."""
    best, found, start = 0.0, None, 0
    for k, width in enumerate(inputs.widths):
        own_n, own_s = n[start:start + width], s[start:start + width]
        start += width
        rows, whole = own_n.sum(), own_s.sum()
        # Numeric columns split between two bins, categories into one level and the others.
        hot = k >= len(inputs.numeric)
        nl, sl = (rows - own_n[:-1], whole - own_s[:-1]) if hot else (np.cumsum(own_n)[:-1], np.cumsum(own_s)[:-1])
        nr, sr = rows - nl, whole - sl
        valid = (nl >= 1) & (nr >= 1)
        if not valid.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(valid, (sl * sl / nl + sr * sr / nr - whole * whole / rows) / rows, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > best:
            values = np.arange(width)
            best, found = gain[at], (k, values == at if hot else values > at, sl[at] / nl[at], sr[at] / nr[at])
    return found


def _blocks(train: DataFrame, inputs: Inputs, targets: list[str], path: str) -> None:
    """Write the training rows as blocks: the bins of all columns, and the doubles of all targets."""
    width = len(inputs.widths)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = inputs.binned(batch.columns[:width])
                left = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[width:]])
                if np.isnan(left).any():
                    raise ValueError("null or NaN in a target")
                yield _block(rows, left)

    columns = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*inputs.numeric, *inputs.categories, *targets])]
    train.select(*columns).mapInArrow(run, "bins binary, rest binary").write.parquet(path)


def _block(rows: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rows.tobytes()]), pa.array([left.tobytes()])], ["bins", "rest"])


def _read_blocks(batches: Iterable[pa.RecordBatch], inputs: Inputs, targets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    kind = np.uint8 if max(inputs.widths, default=0) <= 256 else np.int32
    for batch in batches:
        for bins, left in zip(*batch.columns):
            left = np.frombuffer(left.as_buffer(), float).reshape(targets, -1)
            yield np.frombuffer(bins.as_buffer(), kind).reshape(-1, left.shape[1]), left


def _level_sums(blocks: DataFrame, inputs: Inputs, trees: list[Tree], level: int, scale: float) -> np.ndarray:
    """For each target and node of a level: the rows and the sum of each column's values, and the sum of squares.

    A task adds up its blocks in one array, whose cells are then summed; they are as many however many rows there are.
    """
    first, nodes, cells = (1 << level) - 1, 1 << level, sum(inputs.widths)
    shared = blocks.sparkSession.sparkContext.broadcast((inputs, trees))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, trees = shared.value
        held = np.zeros((len(trees), 3, nodes, cells))
        for rows, left in _read_blocks(batches, inputs, len(trees)):
            for tree, own, rest in zip(trees, held, left):
                label, node = scale * rest, tree.nodes(rows, level) - first
                # Rows of leaves above go to a place of their own, which is left out.
                node = np.where(node < 0, nodes, node)
                own[2, :, 0] += np.bincount(node, label * label, nodes + 1)[:-1]
                start = 0
                for values, width in zip(rows, inputs.widths):
                    key, end = node * width + values, start + width
                    own[0, :, start:end] += np.bincount(key, minlength=(nodes + 1) * width).reshape(-1, width)[:-1]
                    own[1, :, start:end] += np.bincount(key, label, (nodes + 1) * width).reshape(-1, width)[:-1]
                    start = end
        flat = held.ravel()
        met = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(flat[met])], ["cell", "v"])

    spark = blocks.sparkSession
    with shuffles_freed(spark), _few_at_a_time(spark, BLOCKS_AT_ONCE):
        found = blocks.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros(len(trees) * 3 * nodes * cells)
    sums[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    shared.destroy()
    return sums.reshape(len(trees), 3, nodes, cells)


def _grow(blocks: DataFrame, inputs: Inputs, targets: int, depth: int, scale: float) -> list[Tree]:
    """A tree for each target, a level of all of them at a time."""
    trees = [Tree.empty(depth, max(inputs.widths, default=0)) for _ in range(targets)]
    for level in range(depth):
        growing = False
        for tree, (n, s, q) in zip(trees, _level_sums(blocks, inputs, trees, level, scale)):
            for k in range(1 << level):
                # Every row is in one cell of the first column.
                rows, whole = n[k, :inputs.widths[0]].sum(), s[k, :inputs.widths[0]].sum()
                node = (1 << level) - 1 + k
                if not rows:
                    continue
                tree.value[node] = whole / rows
                if level and abs(q[k, 0] / rows - tree.value[node] ** 2) < LEAST_IMPURITY:
                    continue
                if split := _best_split(n[k], s[k], inputs):
                    tree.column[node], right, tree.value[2 * node + 1], tree.value[2 * node + 2] = split
                    tree.right[node, :len(right)] = right
                    growing = True
        if not growing:
            break
    return trees


def _less_trees(blocks: DataFrame, inputs: Inputs, trees: list[Tree], depth: int, weight: float, path: str) -> None:
    """Write the blocks with what the trees leave of the targets."""
    shared = blocks.sparkSession.sparkContext.broadcast((inputs, trees))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, trees = shared.value
        for rows, left in _read_blocks(batches, inputs, len(trees)):
            yield _block(rows, left - weight * np.stack([tree.value[tree.nodes(rows, depth)] for tree in trees]))

    with _few_at_a_time(blocks.sparkSession, BLOCKS_AT_ONCE):
        blocks.mapInArrow(run, "bins binary, rest binary").write.parquet(path)
    shared.destroy()


def fit_boosted_targets(
    train: DataFrame, targets: list[str], numeric: list[str], categories: list[str], levels: list[int],
    seed: int = 1, rounds: int = 10, depth: int = 5,
) -> BoostedTargets:
    """Boosted trees of every target on shared inputs; indexed categories have so many ``levels``, each a split of its own.

    What reaches the driver is a bounded sample, and a level's sums by node and bin.
    """
    spark, inputs = train.sparkSession, _inputs(train, list(numeric), list(categories), levels, seed)
    path = scratch_path(spark)
    with shuffles_freed(spark):
        _blocks(train, inputs, targets, path)
    found: list[list[Tree]] = []
    for k in range(rounds):
        blocks = spark.read.schema("bins binary, rest binary").parquet(path)
        # The gradient of the squared error is twice what is left.
        found.append(_grow(blocks, inputs, len(targets), depth, 2.0 if k else 1.0))
        if k + 1 < rounds:
            further = scratch_path(spark)
            _less_trees(blocks, inputs, found[-1], depth, STEP if k else 1.0, further)
            dropped(spark, path)
            path = further
    dropped(spark, path)
    return BoostedTargets(inputs, depth, {t: [trees[j] for trees in found] for j, t in enumerate(targets)})
