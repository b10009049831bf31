"""Which drawings of a cell can be near to drawings of another: bounds that follow from angles.

Nothing is estimated here: a drawing that is ruled out is near to no drawing of
the other cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from drawloom.llm.collisions import Cells, strip_of
from drawloom.llm.drawings import unit, unpack

#: Radians that bounds are widened by, for what float32 loses near cosine 1.
ROUNDING = 0.01
#: Cells up to which a radius is kept for each pair of them (64 MB); beyond, one for each cell, which rules out less.
PAIRED = 4096


class Bounds:
    """Which drawings of one cell can be within an angle of any drawing of another.

    For a pair of cells every drawing is seen by its projection to the plane of
    the two cells' means and by the length of the rest. The angle of these three
    coordinates is at most the angle of the drawings (Cauchy-Schwarz for the
    rest), and a cell is narrow in them: its drawings lie within `radii` of a centre.
    """

    def __init__(self, means: np.ndarray, clusters: np.ndarray, angle: float, paired: bool = True):
        length = np.sqrt(np.einsum("ij,ij->i", means, means)).clip(1e-6, 1)
        self.means = (means / length[:, None]).astype(np.float32)
        self.length, self.rest = length.astype(np.float32), np.sqrt(1 - length**2).astype(np.float32)
        self.clusters = clusters
        self.angle = angle
        self.paired = paired  #: whether radii are kept for each pair of cells
        self.radii = None  #: [cell, other]: of the cell's drawings, seen with the other; or [cell, 1]: whatever the other

    def seen(self, u: np.ndarray, cell: int):
        """A cell's drawings in the plane with every other cell (x along its own mean, y across) and the rest's length z; and the cosine g of the means.

        float32 throughout: what it loses is of the size of what the products of float32 vectors lose, see ROUNDING.
        """
        y = u @ self.means.T
        x = y[:, cell].copy()[:, None]
        g = self.means @ self.means[cell]
        y -= g * x
        y /= self.across(g)
        z = 1 - x * x - y * y
        np.sqrt(np.maximum(z, 0, out=z), out=z)
        return x, y, z, g

    @staticmethod
    def across(g: np.ndarray) -> np.ndarray:
        return np.sqrt((1 - g * g).clip(1e-4))

    def strips(self, u: np.ndarray, cell: np.ndarray):
        """(cell, rows) of bounded numbers of rows of one cell."""
        strip = strip_of(8 * len(self.means), 1024)
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            for lo in range(0, len(rows), strip):
                yield c, rows[lo : lo + strip]

    def widest(self, u: np.ndarray, cell: np.ndarray, into: dict[int, np.ndarray]) -> None:
        for c, rows in self.strips(u, cell):
            x, _, z, _ = self.seen(u[rows], c)
            z *= self.rest[c]
            z += x * self.length[c]  # the cosine to the cell's own centre
            most = np.arccos(z.min(axis=0).clip(-1, 1))
            if not self.paired:
                most = most.max(keepdims=True)
            into[c] = np.maximum(into[c], most) if c in into else most

    def candidates(self, u: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, other cell): the rows that may be within the angle of a drawing of a cell of another cluster."""
        got, others = [np.zeros(0, int)], [np.zeros(0, int)]
        for c, rows in self.strips(u, cell):
            radii = self.radii[:, c if self.paired else 0]
            x, y, z, g = self.seen(u[rows], c)
            y *= self.across(g) * self.length
            z *= self.rest
            z += y
            z += x * (g * self.length)  # the cosine to the other cell's centre
            least = np.cos(np.minimum(radii + self.angle + ROUNDING, np.pi)).astype(np.float32)
            least[g * g > 1 - 1e-4] = -2  # hardly a plane: nothing is ruled out
            least[self.clusters == self.clusters[c]] = 2
            i, j = np.nonzero(z >= least)
            got.append(rows[i])
            others.append(j)
        return np.concatenate(got), np.concatenate(others)


def total(table: pa.Table) -> pa.Table:
    """Kernel of one cell: the sum of its blocks' sums."""
    v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float32).reshape(table.num_rows, -1).sum(axis=0, dtype=np.float64)
    return pa.table([table.column("cell").slice(0, 1), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["cell", "n", "v"])


def widest(table: pa.Table) -> pa.Table:
    """Kernel of one cell: the greatest of its radii."""
    v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float32).reshape(table.num_rows, -1).max(axis=0)
    return pa.table([table.column("cell").slice(0, 1), pa.array([v.tobytes()], pa.binary())], names=["cell", "v"])


def bounds_of(cells: Cells, angle: float, clusters: np.ndarray | None = None) -> Bounds:
    """Bounds of all cells; rows count as candidates only for cells of another cluster (each cell its own, unless given).

    Two passes over the drawings. The driver gets a mean a cell, and a radius for each pair of cells (or each cell, see PAIRED).
    """
    spark = cells.rows.sparkSession
    n = len(cells.index.reps)
    means = cells.index.reps.astype(np.float64)

    def add(batches):
        for batch in batches:
            cell, u = batch.column(0).to_numpy(), unit(unpack(batch.column(1)))
            found, back, counts = np.unique(cell, return_inverse=True, return_counts=True)
            order = np.argsort(back, kind="stable")
            sums = np.add.reduceat(u[order], np.cumsum(counts) - counts, axis=0, dtype=np.float64) if len(cell) else np.zeros((0, u.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in sums], pa.binary())], names=["cell", "n", "v"])

    narrow = cells.rows.select("cell", "v")
    for r in narrow.mapInArrow(add, "cell int, n bigint, v binary").groupBy("cell").applyInArrow(total, "cell int, n bigint, v binary").collect():
        means[r.cell] = np.frombuffer(r.v) / r.n
    bounds = Bounds(means, np.arange(n) if clusters is None else clusters, angle, n <= PAIRED)
    first = spark.sparkContext.broadcast(bounds)

    def measure(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            first.value.widest(unit(unpack(batch.column(1))), batch.column(0).to_numpy(), found)
        for c, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["cell", "v"])

    radii = np.zeros((n, n if bounds.paired else 1), np.float32)
    for r in narrow.mapInArrow(measure, "cell int, v binary").groupBy("cell").applyInArrow(widest, "cell int, v binary").collect():
        radii[r.cell] = np.frombuffer(r.v, np.float32)
    bounds.radii = radii
    return bounds


def candidates_of(cells: Cells, bounds: Bounds):
    """(row_id, cell, other, v): the drawings that may be near to one of cell `other`."""
    second = cells.rows.sparkSession.sparkContext.broadcast(bounds)

    def choose(batches):
        for batch in batches:
            cell = batch.column(1).to_numpy()
            i, other = second.value.candidates(unit(unpack(batch.column(2))), cell)
            for lo in range(0, len(i), 8192):
                at = pa.array(i[lo : lo + 8192])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(other[lo : lo + 8192].astype(np.int32)), batch.column(2).take(at)], names=["row_id", "cell", "other", "v"])

    return cells.rows.select("row_id", "cell", "v").mapInArrow(choose, "row_id bigint, cell int, other int, v binary")
