"""Iterative training of softmax models over stored batches.

Both trainers keep only the weight matrix (classes x features) on the driver.
The rows are dealt to batches by a hash of their row id and stored once, a
folder per batch, so a step reads its own batch and nothing else.  They are
stored as blocks of some thousand rows, each one cell of bytes with the values
column by column: a pass hands them to numpy and touches no single value on
the way.  A column of few different values in a block is a list of them and a
number per row, so that most of a block need not travel.

``train_minibatch`` takes one step of AdamW per batch: gradient, loss and
confusion counts of a batch come from one aggregate.  The order of the batches
is drawn anew every epoch.  Validation after each epoch lowers the rate on a
plateau of the loss, stops early by macro F1, and the best weights win.

``train_variance_reduced`` is for models that L-BFGS did not finish.  A pass
takes the gradient of all rows at the reference weights; every task then walks
its own rows in small steps whose gradients are corrected by that reference,
and the tasks' weights are averaged.  Steps are scaled by the curvature of
each class, so the passes needed do not depend on how features are related.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import encode
from ..schema import SEED, ident
from ..workspace import materialize, settings
from .scoring import linear_model

# Settings of the mini-batch trainer.
BATCH_ROWS = 1024
LEARNING_RATE = 0.01
WEIGHT_DECAY = 1e-4
EPOCHS = 100
EARLY_STOP_PATIENCE = 10
EARLY_STOP_DELTA = 0.001
RATE_PATIENCE = 5
RATE_FACTOR = 0.5
RATE_THRESHOLD = 1e-4
MOMENTS = (0.9, 0.999)
EPSILON = 1e-8

#: A step is a job, so an epoch has at most this many; larger tables get larger batches.
MOST_BATCHES = 8
#: Rows of a block: at most 2 MB of 28 features, 2.7 MB of 39.
BLOCK_ROWS = 8_192
#: A task holds a few blocks at a time, on their way from the file and to Python.
_FEW_BLOCKS = {"spark.sql.parquet.columnarReaderBatchSize": "4", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Spark removes the shuffle files of a query once it has ended.
_PASSING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of a batch that share a file, and so a task: at most so many, and no more than keep all cores busy with files of so many.
FILE_ROWS = 250_000
LEAST_FILE_ROWS = 4_096
#: Steps are halved down to this part before a pass that raises the objective counts as one that does not better it.
SMALLEST_STEP = 1 / 64
#: Rows of a corrected step inside a task.
STEP_ROWS = 256


@dataclass
class Weights:
    """A softmax model: a row per class, the last column is the intercept."""

    matrix: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = x @ self.matrix[:, :-1].T + self.matrix[:, -1]
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    def model(self, spark: SparkSession) -> LogisticRegressionModel:
        return linear_model(spark, self.matrix[:, :-1].tolist(), self.matrix[:, -1].tolist())


@dataclass
class Batches:
    """Stored training rows: blocks and their batch."""

    blocks: DataFrame
    features: int
    classes: int
    batches: int
    rows: int

    @property
    def data(self) -> DataFrame:
        """The rows of the blocks: the features as an array x, the class y, the weight w, and batch."""
        features = self.features

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (x, y, w), number in zip(_arrays(batch, features), batch.column(1).to_pylist()):
                    lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, features, dtype=np.int32), x.T.ravel())
                    yield pa.RecordBatch.from_arrays(
                        [lists, pa.array(y, pa.int32()), pa.array(w), pa.array(np.full(len(y), number, np.int32))], ["x", "y", "w", "batch"])

        return self.blocks.select("block", "batch").mapInArrow(unpacked, "x array<double>, y int, w double, batch int")


def files_of(rows: int, cores: int) -> int:
    """Files of a batch of ``rows`` rows: a step is one job over one batch, so every core needs a file of it."""
    return max(1, -(-rows // FILE_ROWS), min(cores, rows // LEAST_FILE_ROWS))


def stored_batches(
    df: DataFrame, row_id: str, features: list[str], label: str, classes: list[str], weight: str,
    batch_rows: int = BATCH_ROWS, most: int = MOST_BATCHES, seed: int = SEED,
) -> Batches:
    """Rows dealt to batches by the hash of their id, written once."""
    rows = df.count()
    number = max(1, min(most, -(-rows // batch_rows)))
    x = F.array(*[F.col(ident(f)).cast("double") for f in features]).alias("x")
    files = files_of(-(-rows // number), df.sparkSession.sparkContext.defaultParallelism)
    batch = F.pmod(F.xxhash64(F.col(ident(row_id)), F.lit(seed)), F.lit(number)).cast("int").alias("batch")
    dealt = df.select(x, encode(F.col(ident(label)), classes).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), batch)
    width = len(features)
    # whole blocks are shuffled, and each file gets as many as the others
    blocks = dealt.mapInArrow(lambda parts: _packed(parts, width, number, files), "block binary, batch int, place int")
    spread = blocks.repartitionById(number * files, F.col("place")).drop("place")
    with settings(df.sparkSession, _PASSING):
        stored = materialize(spread, "batches", ["batch"])
    return Batches(stored, width, len(classes), number, rows)


def _encoded(columns: np.ndarray) -> bytes:
    """The columns (a row of the array each) as bytes, every bit kept.

    First the number of rows and, for each column, of the values it lists (0: it is whole); then the lists and whole
    columns; then the place in its list of each value, in one byte or two.
    """
    rows = columns.shape[1]
    sizes, values, places = [rows], [], []
    for column in columns.view(np.int64):
        listed, place = np.unique(column, return_inverse=True)
        short = len(listed) <= min(rows // 2, 1 << 16)
        sizes.append(len(listed) if short else 0)
        values.append(listed if short else column)
        if short:
            places.append(place.astype(np.uint8 if len(listed) <= 256 else np.uint16))
    return b"".join([np.array(sizes).tobytes(), *[v.tobytes() for v in values], *[p.tobytes() for p in places]])


def _decoded(block: pa.Buffer, columns: int) -> np.ndarray:
    """The array that ``_encoded`` was given."""
    rows, *sizes = np.frombuffer(block, np.int64, columns + 1).tolist()
    out = np.empty((columns, rows))
    at = 8 * (columns + 1)
    places = at + 8 * sum(n or rows for n in sizes)
    for column, n in zip(out, sizes):
        values = np.frombuffer(block, np.float64, n or rows, at)
        at += values.nbytes
        if n:
            place = np.frombuffer(block, np.uint8 if n <= 256 else np.uint16, rows, places)
            places += place.nbytes
            np.take(values, place, out=column, mode="clip")
        else:
            column[:] = values
    return out


def _packed(parts: Iterator[pa.RecordBatch], features: int, number: int, files: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of each batch: the features, then the class and the weight."""
    held: list[list[np.ndarray]] = [[] for _ in range(number)]
    turn = [TaskContext.get().partitionId()] * number

    def block(k: int) -> pa.RecordBatch:
        whole = np.concatenate(held[k], axis=1)
        held[k] = []
        turn[k] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([_encoded(whole)], pa.binary()), pa.array([k], pa.int32()), pa.array([k * files + turn[k] % files], pa.int32())], ["block", "batch", "place"])

    for part in parts:
        x, y, w, of = (part.column(0).flatten(), *part.columns[1:])
        rows = np.concatenate([x.to_numpy(zero_copy_only=False).reshape(-1, features).T, y.to_numpy()[None], w.to_numpy(zero_copy_only=False)[None]])
        of = of.to_numpy()
        for k in np.unique(of).tolist():
            held[k].append(rows[:, of == k])
            if sum(h.shape[1] for h in held[k]) >= BLOCK_ROWS:
                yield block(k)
    for k in range(number):
        if held[k]:
            yield block(k)


def _arrays(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features x rows, classes, weights) of the blocks, or of the rows, in a record batch."""
    if batch.schema.names[0] == "block":
        for value in batch.column(0):
            rows = _decoded(value.as_buffer(), features + 2)
            yield rows[:features], rows[features].astype(np.int64), rows[features + 1]
    elif batch.num_rows:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features).T
        yield x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)


def _columns(data: DataFrame) -> DataFrame:
    """What a pass reads of blocks, or of rows."""
    return data.select("block") if "block" in data.columns else data.select("x", "y", "w")


def _gradient(matrix: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, weighted sum of the gradients); both ``x`` and the probabilities have a column per row."""
    p = matrix[:, :-1] @ x
    p += matrix[:, -1:]
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    off = p.copy()
    off[y, np.arange(len(y))] -= 1
    off *= w
    return p, np.concatenate([off @ x.T, off.sum(axis=1)[:, None]], axis=1)


@dataclass
class Sums:
    gradient: np.ndarray  # of the weighted loss
    loss: float  # weighted
    weight: float
    rows: int
    confusion: np.ndarray  # truth x prediction
    curvature: np.ndarray  # of the weighted loss, one matrix per class


def _added_up(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum of the tasks' vectors.

    There are at most as many tasks as the cluster runs at once, so what
    reaches the driver grows with its cores and not with the rows.
    """
    tasks = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([work(batches).tobytes()], pa.binary())], ["sums"])

    with settings(rows.sparkSession, _FEW_BLOCKS):
        found = tasks.mapInArrow(one, "sums binary").toArrow()["sums"].to_pylist()
    return sum((np.frombuffer(v) for v in sorted(found)), np.zeros(len(found[0]) // 8)) if found else np.zeros(0)


def sums(data: DataFrame, features: int, classes: int, weights: Weights, curved: bool = False) -> Sums:
    """Gradient, loss and confusion counts of all rows of ``data`` (blocks or rows), and the curvature of each class if wanted."""
    n, matrix = features + 1, weights.matrix

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        gradient, rest, confusion = np.zeros((classes, n)), np.zeros(3), np.zeros(classes * classes)
        curvature = np.zeros((classes, n, n) if curved else 0)
        for batch in batches:
            for x, y, w in _arrays(batch, features):
                p, part = _gradient(matrix, x, y, w)
                gradient += part
                rest += [-(w * np.log(np.maximum(p[y, np.arange(len(y))], np.finfo(float).tiny))).sum(), w.sum(), len(y)]
                confusion += np.bincount(y * classes + p.argmax(axis=0), minlength=classes * classes)
                if curved:
                    x = np.concatenate([x, np.ones((1, len(y)))])
                    for k in range(classes):
                        curvature[k] += (x * (w * p[k] * (1 - p[k]))) @ x.T
        return np.concatenate([gradient.ravel(), rest, confusion, curvature.ravel()])

    values = _added_up(_columns(data), work)
    size, cells = classes * n, classes * classes
    values = values if len(values) else np.zeros(size + 3 + cells + (size * n if curved else 0))
    gradient, rest, confusion, curvature = np.split(values, np.cumsum([size, 3, cells]))
    return Sums(gradient.reshape(classes, -1), rest[0], rest[1], int(rest[2]), confusion.reshape(classes, -1), curvature.reshape(-1, n, n))


def macro_f1(confusion: np.ndarray) -> float:
    """Over the labels seen as truth or prediction; empty denominators give 0."""
    both = confusion.sum(axis=0) + confusion.sum(axis=1)
    seen = both > 0
    return float((2 * np.diag(confusion)[seen] / both[seen]).mean()) if seen.any() else 0.0


@dataclass
class Epoch:
    epoch: int
    rate: float
    train_loss: float
    val_loss: float
    train_f1: float
    val_f1: float


@dataclass
class Trained:
    weights: Weights
    best_epoch: int
    history: list[Epoch] = field(default_factory=list)


def train_minibatch(
    train: Batches, val: DataFrame, epochs: int = EPOCHS, patience: int = EARLY_STOP_PATIENCE, delta: float = EARLY_STOP_DELTA,
    rate: float = LEARNING_RATE, decay: float = WEIGHT_DECAY, seed: int = SEED,
) -> Trained:
    """Epochs of AdamW until ``patience`` epochs have not bettered the validation macro F1 by more than ``delta``.

    ``val`` holds blocks, or the columns of ``Batches.data``.  Losses of an epoch are those
    met on the way, weighted by the rows of each batch.
    """
    rng = np.random.default_rng(seed)
    bound = train.features**-0.5
    matrix = rng.uniform(-bound, bound, (train.classes, train.features + 1))
    first, second, step = np.zeros_like(matrix), np.zeros_like(matrix), 0
    best, best_f1, best_epoch, stale = matrix, None, 0, 0
    low, flat = np.inf, 0
    history = []
    for epoch in range(1, epochs + 1):
        loss, rows, confusion = 0.0, 0, np.zeros((train.classes, train.classes))
        for batch in rng.permutation(train.batches).tolist():
            s = sums(train.blocks.where(F.col("batch") == batch), train.features, train.classes, Weights(matrix))
            if not s.weight:
                continue
            gradient = s.gradient / s.weight
            step += 1
            first = MOMENTS[0] * first + (1 - MOMENTS[0]) * gradient
            second = MOMENTS[1] * second + (1 - MOMENTS[1]) * gradient**2
            scaled = (first / (1 - MOMENTS[0] ** step)) / (np.sqrt(second / (1 - MOMENTS[1] ** step)) + EPSILON)
            matrix = matrix * (1 - rate * decay) - rate * scaled
            loss, rows, confusion = loss + s.loss / s.weight * s.rows, rows + s.rows, confusion + s.confusion
        v = sums(val, train.features, train.classes, Weights(matrix))
        val_loss, val_f1 = float(v.loss / v.weight) if v.weight else 0.0, macro_f1(v.confusion)
        history.append(Epoch(epoch, rate, float(loss / max(1, rows)), val_loss, macro_f1(confusion), val_f1))
        if val_loss < low * (1 - RATE_THRESHOLD):
            low, flat = val_loss, 0
        else:
            flat += 1
            if flat > RATE_PATIENCE:
                rate, flat = rate * RATE_FACTOR, 0
        if best_f1 is None or val_f1 > best_f1 + delta:
            best, best_f1, best_epoch, stale = matrix, val_f1, epoch, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return Trained(Weights(best), best_epoch, history)


def epoch_table(spark: SparkSession, trained: Trained) -> DataFrame:
    rows = [(e.epoch, e.rate, e.train_loss, e.val_loss, e.train_f1, e.val_f1, e.epoch == trained.best_epoch) for e in trained.history]
    return spark.createDataFrame(
        rows, "epoch int, rate double, train_loss double, val_loss double, train_f1 double, val_f1 double, kept boolean")


@dataclass
class Pass:
    number: int
    objective: float
    steepest: float  # largest component of the gradient


def objective_of(s: Sums, weights: Weights, penalty: float) -> tuple[float, np.ndarray]:
    """Mean weighted loss plus half the squared weights times ``penalty`` (intercepts are free), and its gradient."""
    slopes = np.concatenate([weights.matrix[:, :-1], np.zeros((len(weights.matrix), 1))], axis=1)
    return float(s.loss / s.weight + penalty / 2 * (slopes**2).sum()), s.gradient / s.weight + penalty * slopes


def train_variance_reduced(
    train: Batches, penalty: float, passes: int = 200, tol: float = 1e-6, seed: int = SEED, start: Weights | None = None, step_rows: int = STEP_ROWS,
) -> tuple[Weights, list[Pass]]:
    """The weights of least objective, and the objective at each pass's reference.

    Ends when the objective falls by less than ``tol`` of itself over three
    passes.  A pass that raised it is taken back and the steps are halved.
    """
    classes, features = train.classes, train.features
    free = np.diag([penalty] * features + [0.0])
    rows = _columns(train.blocks)
    weights = start or Weights(np.zeros((classes, features + 1)))
    size, best, still, history = 1.0, None, 0, []
    for number in range(1, passes + 1):
        found = sums(rows, features, classes, weights, curved=True)
        value, gradient = objective_of(found, weights, penalty)
        history.append(Pass(number, value, float(np.abs(gradient).max())))
        if best is not None and value > best[0]:
            size /= 2
            still += size < SMALLEST_STEP
            _, weights, gradient, scale = best
        else:
            still = still + 1 if best is not None and best[0] - value < tol * max(abs(value), tol) else 0
            # twice the curvature of the classes one by one bounds that of all together
            curve = 2 * found.curvature / found.weight + free
            curve += np.eye(features + 1) * 1e-7 * np.trace(curve, axis1=1, axis2=2)[:, None, None]
            scale = np.linalg.inv(curve)
            best = (value, weights, gradient, scale)
        if still >= 3:
            break
        reference = weights.matrix

        def walk(batches: Iterator[pa.RecordBatch], reference=reference, gradient=gradient, scale=scale, size=size, number=number) -> np.ndarray:
            at, seen = reference.copy(), 0.0
            rng = np.random.default_rng([seed, number, TaskContext.get().partitionId()])
            for batch in batches:
                for x, y, w in _arrays(batch, features):
                    order = rng.permutation(len(y))
                    for part in np.array_split(order, max(1, len(order) // step_rows)):
                        mass = w[part].sum()
                        here, there = (_gradient(m, x[:, part], y[part], w[part])[1] / mass for m in (at, reference))
                        step = here - there + (at - reference) @ free + gradient
                        at -= size * np.einsum("kj,kji->ki", step, scale)
                        seen += mass
            return np.append(at.ravel() * seen, seen)

        values = _added_up(rows, walk)
        weights = Weights((values[:-1] / values[-1]).reshape(classes, -1))
    return best[1], history


def pass_table(spark: SparkSession, history: list[Pass]) -> DataFrame:
    return spark.createDataFrame([(p.number, p.objective, p.steepest) for p in history], "pass int, objective double, steepest double")
