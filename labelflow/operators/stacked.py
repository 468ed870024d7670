"""Multinomial logistic regressions of many settings, fitted in the same passes.

The loss of each setting needs the same thing of the data: class scores of
every row and the sums of class errors times features. So the settings'
coefficients are stacked, and one pass over the stored feature blocks returns
the loss and the gradient of all of them; each setting has an L-BFGS optimiser
of its own on the driver, which holds nothing but coefficients, and leaves the
passes when it has converged. The number of passes is the largest number of
evaluations that one setting needs, not their sum.

An optimiser can be halted after any number of steps and go on later from where
it stood, with its curvature pairs: that is what training in rounds needs
(``rounds``). The penalised loss is that of ``model.fit_logistic``:
``mean(loss) + |W|^2 / (2 C n)``, intercepts free.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import INVERSE_REG, MAX_ITER, TOL
from ..session import ship_package, store

#: Rows of a feature block; the unit that a task reads at once.
BLOCK_ROWS = 2048
#: Rows for which a pass has a task: fewer than in ``model``, as a pass does the sums of all settings in Python.
PASS_ROWS = 4 * BLOCK_ROWS
#: Partial sums that the driver adds itself; more are added on executors first.
FAN_IN = 32
#: Curvature pairs kept by an optimiser.
MEMORY = 10
#: An Armijo step must gain this share of the slope; a step below LEAST_STEP gives up.
SUFFICIENT, LEAST_STEP = 1e-4, 1e-12


@dataclass(frozen=True)
class Setting:
    """One run's parameters. ``tol`` bounds the largest entry of the gradient at the end."""

    name: str
    inverse_reg: float = INVERSE_REG
    max_iter: int = MAX_ITER
    tol: float = TOL


@dataclass
class Blocks:
    """Stored feature blocks: rows, features, class counts, and how many partitions they have."""

    frame: DataFrame
    n_rows: int
    n_features: int
    class_counts: list[int]
    n_partitions: int

    @property
    def n_classes(self) -> int:
        return len(self.class_counts)

    def release(self) -> None:
        self.frame.unpersist()


def _rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """The entries of a list column as arrays (null: None)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, values = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)
    valid = np.asarray(column.is_valid())
    return [values[a:b] if v else None for a, b, v in zip(ends[:-1], ends[1:], valid, strict=True)]


def feature_blocks(feats: DataFrame, n_features: int, n_classes: int, features_col: str = "features",
                   label_col: str = "_y") -> Blocks:
    """``(features, label)`` rows as compressed sparse blocks, stored once and kept in memory or on disk.

    A block holds at most ``BLOCK_ROWS`` rows; sparse and dense vectors are
    accepted, and structs of ``indices`` and ``values``. A label outside 0 to ``n_classes - 1`` raises."""
    ship_package(feats.sparkSession)
    is_struct = isinstance(feats.schema[features_col].dataType, StructType)
    vector = F.col(features_col) if is_struct else F.unwrap_udt(features_col)
    rows = feats.select(vector["indices"].alias("indices"), vector["values"].alias("values"), F.col(label_col).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                values = _rows_of(part.column(1))
                indices = [np.arange(len(v), dtype=np.int32) if i is None else i
                           for i, v in zip(_rows_of(part.column(0)), values, strict=True)]
                y = part.column(2).to_numpy(zero_copy_only=False)
                if len(y) and not ((y >= 0) & (y < n_classes)).all():
                    raise ValueError(f"labels must be numbers from 0 to {n_classes - 1}, found {sorted(set(y.tolist()))[:5]}")
                sizes = np.array([len(v) for v in values], np.int32)
                parts = [sizes, np.concatenate(indices).astype(np.int32), np.concatenate(values).astype(np.float64), y.astype(np.int32)]
                counts = np.bincount(parts[3], minlength=n_classes)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([p.tobytes()], pa.binary()) for p in parts], pa.array([counts.tolist()], pa.list_(pa.int64()))],
                    names=["sizes", "indices", "entries", "labels", "counts"])

    schema = "sizes binary, indices binary, entries binary, labels binary, counts array<bigint>"
    frame = store(rows.mapInArrow(run, schema), "feature-blocks").persist()
    found = frame.agg(*[F.sum(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(n_classes)]).first()
    counts = [int(c or 0) for c in found]
    return Blocks(frame, sum(counts), n_features, counts, max(1, frame.rdd.getNumPartitions()))


@dataclass
class _Block:
    """One block in a task."""

    row: np.ndarray
    index: np.ndarray
    entry: np.ndarray
    y: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> _Block:
        sizes, index, entry, y = (np.frombuffer(batch.column(j)[i].as_buffer(), t)
                                  for j, t in enumerate((np.int32, np.int32, np.float64, np.int32)))
        return cls(np.repeat(np.arange(len(sizes)), sizes), index, entry, y)

    def log_probabilities(self, weights: np.ndarray) -> np.ndarray:
        """``[row, class]`` for weights ``[class, feature + 1]``, the last one the intercept."""
        n, z = len(self.y), np.empty((len(self.y), len(weights)))
        for k, w in enumerate(weights):
            z[:, k] = np.bincount(self.row, self.entry * w[self.index], n) + w[-1]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _loss_and_gradient(weights: np.ndarray, block: _Block) -> np.ndarray:
    """``[setting, 1 + classes * (features + 1)]``: summed loss and its gradient."""
    out = np.zeros((len(weights), 1 + weights[0].size))
    at = np.arange(len(block.y))
    for r, w in enumerate(weights):
        logs = block.log_probabilities(w)
        out[r, 0] = -logs[at, block.y].sum()
        error = np.exp(logs)
        error[at, block.y] -= 1.0
        gradient = out[r, 1:].reshape(w.shape)
        for k in range(len(w)):
            gradient[k, :-1] = np.bincount(block.index, block.entry * error[block.row, k], w.shape[1] - 1)
        gradient[:, -1] = error.sum(axis=0)
    return out


def _loss_and_pairs(weights: np.ndarray, block: _Block) -> np.ndarray:
    """``[setting, 1 + classes ** 2]``: summed loss, and rows by (label, predicted label)."""
    k = weights.shape[1]
    out = np.zeros((len(weights), 1 + k * k))
    for r, w in enumerate(weights):
        logs = block.log_probabilities(w)
        out[r, 0] = -logs[np.arange(len(block.y)), block.y].sum()
        out[r, 1:] = np.bincount(block.y * k + logs.argmax(axis=1), minlength=k * k)
    return out


def one_pass(blocks: Blocks, weights: np.ndarray, of_block: Callable[[np.ndarray, _Block], np.ndarray]) -> np.ndarray:
    """Sum of ``of_block(weights, block)`` over all blocks, by one job.

    Each task adds up its own blocks; many tasks' sums are added in groups on
    executors before the driver sees the square root of their number."""
    spark = blocks.frame.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = of_block(sent.value, _Block.read(batch, i))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                names=["part", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t.as_buffer()) for t in table.column("total"))
        return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    schema = "part int, total binary"
    sums = blocks.frame.drop("counts").mapInArrow(run, schema)
    if blocks.n_partitions > FAN_IN:
        group = F.pmod("part", F.lit(math.isqrt(blocks.n_partitions)))
        sums = sums.groupBy(group).applyInArrow(add, schema)
    shape = of_block(weights, _Block(*[np.zeros(0, t) for t in (np.int64, np.int32, np.float64, np.int32)])).shape
    # a fixed order of addition: the same sums on every run
    parts = sorted((r["part"], bytes(r["total"])) for r in sums.collect())
    sent.destroy()
    return sum((np.frombuffer(t).reshape(shape) for _, t in parts), np.zeros(shape))


class Lbfgs:
    """Limited-memory quasi-Newton steps, driven from outside: evaluate at ``trial``, ``tell`` the result."""

    def __init__(self, start: np.ndarray, max_iter: int, tol: float):
        self.trial, self.max_iter, self.tol = start, max_iter, tol
        self.x = self.gradient = self.direction = None
        self.value = math.inf
        self.iteration, self.step, self.slope, self.done = 0, 1.0, 0.0, False
        self.pairs: deque = deque(maxlen=MEMORY)

    def tell(self, value: float, gradient: np.ndarray) -> None:
        if self.x is not None and not value <= self.value + SUFFICIENT * self.step * self.slope:
            self.step /= 2
            self.done = self.step < LEAST_STEP
            self.trial = self.x + self.step * self.direction
            return
        if self.x is not None:
            s, y = self.trial - self.x, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.pairs.append((s, y, 1.0 / (s @ y)))
            self.iteration += 1
        self.x, self.value, self.gradient = self.trial, value, gradient
        self.done = np.abs(gradient).max(initial=0.0) <= self.tol or self.iteration >= self.max_iter
        if not self.done:
            self.direction = -self._scaled(gradient)
            self.slope = self.direction @ gradient
            self.step = 1.0 if self.pairs else min(1.0, 1.0 / np.linalg.norm(gradient))
            self.trial = self.x + self.step * self.direction

    def _scaled(self, gradient: np.ndarray) -> np.ndarray:
        """The inverse Hessian's estimate times the gradient (two loops over the pairs)."""
        q, factors = gradient.copy(), []
        for s, y, rho in reversed(self.pairs):
            factors.append(rho * (s @ q))
            q -= factors[-1] * y
        if self.pairs:
            s, y, rho = self.pairs[-1]
            q /= rho * (y @ y)
        for (s, y, rho), a in zip(self.pairs, reversed(factors), strict=True):
            q += (a - rho * (y @ q)) * s
        return q


class StackedFit:
    """The optimisers of several settings over the same blocks."""

    def __init__(self, blocks: Blocks, settings: Sequence[Setting]):
        if len({s.name for s in settings}) != len(settings):
            raise ValueError("settings must have different names")
        if not blocks.n_rows:
            raise ValueError("no labelled rows to fit")
        self.blocks, self.settings, self.passes = blocks, list(settings), 0
        self.shape = (blocks.n_classes, blocks.n_features + 1)
        start = np.zeros(self.shape)
        # the best model without features: intercepts that give the classes' shares (an unseen class: half a row)
        start[:, -1] = np.log(np.maximum(blocks.class_counts, 0.5) / blocks.n_rows)
        self.runs = [Lbfgs(start.ravel(), s.max_iter, s.tol) for s in self.settings]

    @property
    def done(self) -> bool:
        return all(r.done for r in self.runs)

    def evaluate_start(self) -> None:
        """The loss at the starting point, by one pass for all."""
        if any(r.x is None for r in self.runs):
            self._pass([i for i, r in enumerate(self.runs) if r.x is None])

    def advance(self, steps: int | None = None) -> None:
        """So many steps more for every setting that has not finished (None: to the end)."""
        self.evaluate_start()
        until = [math.inf if steps is None else r.iteration + steps for r in self.runs]
        while active := [i for i, r in enumerate(self.runs) if not r.done and r.iteration < until[i]]:
            self._pass(active)

    def _pass(self, active: list[int]) -> None:
        trials = np.stack([self.runs[i].trial.reshape(self.shape) for i in active])
        sums = one_pass(self.blocks, trials, _loss_and_gradient) / self.blocks.n_rows
        self.passes += 1
        for i, w, row in zip(active, trials, sums, strict=True):
            penalty = 1.0 / (self.settings[i].inverse_reg * self.blocks.n_rows)
            free = w.copy()
            free[:, -1] = 0.0
            self.runs[i].tell(row[0] + penalty / 2 * float((free * free).sum()), row[1:] + penalty * free.ravel())

    def weights(self) -> np.ndarray:
        """``[setting, class, feature + 1]``, intercepts centred."""
        found = np.stack([r.x.reshape(self.shape) for r in self.runs])
        found[:, :, -1] -= found[:, :, -1].mean(axis=1, keepdims=True)
        return found

    def gradients(self) -> list[float]:
        """The largest gradient entry of each setting where it stands."""
        return [float(np.abs(r.gradient).max(initial=0.0)) for r in self.runs]


def fit_stacked(blocks: Blocks, settings: Sequence[Setting]) -> StackedFit:
    """All settings fitted to the end; ``weights()`` holds their coefficients, ``passes`` counts the passes."""
    fit = StackedFit(blocks, settings)
    fit.advance()
    return fit


def evaluate_stacked(blocks: Blocks, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss of each setting, and its rows by ``[label, predicted label]``, by one pass."""
    k = blocks.n_classes
    sums = one_pass(blocks, weights, _loss_and_pairs)
    return sums[:, 0] / max(blocks.n_rows, 1), sums[:, 1:].reshape(-1, k, k).astype(np.int64)


def as_model(weights: np.ndarray) -> LogisticRegressionModel:
    """A Spark ML classifier of given weights ``[class, feature + 1]``: it saves, loads and scores like a fitted one."""
    classes, width = weights.shape
    name = "org.apache.spark.ml.classification.LogisticRegressionModel"
    model = LogisticRegressionModel._create_from_java_class(
        name, f"stacked_{uuid.uuid4().hex[:12]}", DenseMatrix(classes, width - 1, weights[:, :-1].ravel().tolist(), True),
        Vectors.dense(weights[:, -1]), classes, True)
    return model.setFeaturesCol("features")
