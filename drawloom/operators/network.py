"""Dense networks: layer specifications, initial weights, and two forward passes.

`forward_columns` is plain column expressions, for narrow layers and for
reading the plan; `forward` multiplies Arrow batches with the weights, for wide
inputs. A row whose x is null, of another width or holds a null or NaN gets a
null output in both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawloom.functions.arrays import is_complete
from drawloom.operators.kernels import lists, matrix

ACTIVATIONS = ("sigmoid", "relu", None)
#: Values of weights that the driver takes: the parameter table is bounded by the network, not by the data.
MAX_WEIGHTS = 50_000_000


@dataclass(frozen=True)
class Dense:
    units: int
    activation: str | None = None

    def __post_init__(self):
        if self.activation not in ACTIVATIONS or self.units < 1:
            raise ValueError(f"no such layer: {self}")


def sequential(*layers: Dense) -> list[Dense]:
    return list(layers)


#: Layers, loss, learning rate, batch limit and epochs of the seven recorded experiments (fixed values).
EXPERIMENTS = {
    "E1": ([Dense(128, "sigmoid"), Dense(10, "sigmoid")], "l2", 0.01, 625, 10),
    "E2": ([Dense(128, "sigmoid"), Dense(10)], "softmax_ce", 0.01, 625, 10),
    "E3": ([Dense(128, "relu"), Dense(10)], "softmax_ce", 0.01, 625, 5),
    "E4": ([Dense(128, "relu"), Dense(10)], "softmax_ce", 0.001, 625, 10),
    "E5": ([Dense(512, "relu"), Dense(256, "relu"), Dense(128, "relu"), Dense(64, "relu"), Dense(10)], "softmax_ce", 0.001, 625, 10),
    "E6": ([Dense(512, "sigmoid"), Dense(256, "sigmoid"), Dense(128, "sigmoid"), Dense(64, "sigmoid"), Dense(10)], "softmax_ce", 0.01, 625, 10),
    "E7": ([Dense(512, "relu"), Dense(256, "relu"), Dense(128, "relu"), Dense(64, "relu"), Dense(10)], "softmax_ce", 0.001, 0, 10),
}

Weights = list[tuple[np.ndarray, np.ndarray, str | None]]


def xavier(layers: list[Dense], width: int, seed: int, magnitude: float = 2.24) -> Weights:
    """Uniform weights within sqrt(magnitude / mean fan), biases 0; widths follow from the input's."""
    rng, out = np.random.default_rng(seed), []
    for layer in layers:
        s = np.sqrt(magnitude / ((width + layer.units) / 2))
        out.append((rng.uniform(-s, s, (layer.units, width)), np.zeros(layer.units), layer.activation))
        width = layer.units
    return out


def params_frame(spark: SparkSession, weights: Weights, run_id: str, epoch: int) -> DataFrame:
    rows = [
        (run_id, epoch, k, u, act, [float(v) for v in w[u]], float(b[u]))
        for k, (w, b, act) in enumerate(weights)
        for u in range(len(b))
    ]
    return spark.createDataFrame(rows, "run_id string, epoch int, layer int, unit int, activation string, w array<double>, b double")


def load_weights(params: DataFrame, run_id: str, epoch: int | None = None) -> Weights:
    """The weights of a run (of its last epoch, if none is named) on the driver, size-checked first.

    A null activation is linear. Of repeated (layer, unit) rows the first in value order counts.
    """
    mine = params.where(F.col("run_id") == run_id)
    epoch = mine.agg(F.max("epoch")).first()[0] if epoch is None else epoch
    mine = mine.where(F.col("epoch") == epoch) if epoch is not None else mine
    size = mine.agg(F.sum(F.size("w"))).first()[0] or 0
    if not 0 < size <= MAX_WEIGHTS:
        raise ValueError(f"run {run_id!r} has {size} weights")
    rows = mine.dropDuplicates(["layer", "unit"]).orderBy("layer", "unit").collect()
    out: Weights = []
    for k in sorted({r.layer for r in rows}):
        of = [r for r in rows if r.layer == k]
        out.append((np.array([r.w for r in of], float), np.array([r.b for r in of], float), of[0].activation))
    return out


def param_shapes(params: DataFrame) -> DataFrame:
    """Units and input width of each layer."""
    return params.groupBy("run_id", "epoch", "layer").agg(
        F.countDistinct("unit").alias("units"), F.max(F.size("w")).alias("width"), F.max("activation").alias("activation")
    )


def activate(z: np.ndarray, name: str | None) -> np.ndarray:
    if name == "sigmoid":
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-z))
    return np.maximum(z, 0.0) if name == "relu" else z


def propagate(x: np.ndarray, weights: Weights) -> list[np.ndarray]:
    """The input and each layer's output."""
    out = [x]
    for w, b, act in weights:
        out.append(activate(out[-1] @ w.T + b, act))
    return out


def activation_column(z: Column, name: str | None) -> Column:
    if name == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return F.greatest(z, F.lit(0.0)) if name == "relu" else z


def dense_column(x: Column, w: np.ndarray, b: np.ndarray, activation: str | None) -> Column:
    """One layer as a column: an array of units. Meant for narrow layers; the weights become literals."""
    units = []
    for row, bias in zip(w, b):
        weights = F.lit([float(v) for v in row])
        z = F.aggregate(F.zip_with(x, weights, lambda p, q: p.cast("double") * q), F.lit(float(bias)), lambda s, v: s + v)
        units.append(activation_column(z, activation))
    return F.when(is_complete(x, w.shape[1]), F.array(*units))


def forward_columns(df: DataFrame, weights: Weights, x: str = "x", output: str = "output") -> DataFrame:
    """Every layer as one column expression; `output` replaces a column of that name."""
    h = F.col(x)
    names = []
    for k, (w, b, act) in enumerate(weights):
        names.append(f"__drawloom_h{k}")
        df = df.withColumn(names[-1], dense_column(h, w, b, act))
        h = F.col(names[-1])
    return df.withColumn(output, h).drop(*names)


def forward(df: DataFrame, weights: Weights, x: str = "x", output: str = "output", keep: list[str] | None = None) -> DataFrame:
    """The network's output for every row, by matrix products over Arrow batches.

    `keep` names the columns that come along (all but x by default); only they and x are read.
    """
    keep = [c for c in ([c for c in df.columns if c != x] if keep is None else keep) if c != output]
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{x}`").alias("__drawloom_x"))
    schema = narrow.drop("__drawloom_x").schema.add(output, T.ArrayType(T.DoubleType()))
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        nets = shared.value
        for batch in batches:
            values, ok = matrix(batch.column(batch.num_columns - 1), nets[0][0].shape[1])
            made = propagate(values, nets)[-1] if len(values) else np.zeros((0, len(nets[-1][1])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(made, ok)], names=[*keep, output])

    return narrow.mapInArrow(run, schema)
