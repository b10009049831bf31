"""Collision-counting hashing over representatives of cells, and the cells' formation.

Every hash function is one random projection with its values in sorted order.
A query's window on a projection is centred on the query; windows start narrow
and are widened level by level (virtual rehashing) for the queries that have
found nothing yet. Representatives that lie in at least `threshold` of a
query's windows are verified by their cosine.

The windows are counted 64 representatives at a time: for every projection the
prefixes of the sorted order are kept as bitsets, a window is the difference of
two prefixes, and the windows are added up by bitwise full adders.

Which drawings become representatives is learnt from bounded samples; every
drawing is then put into a cell. What no representative is near to is sampled
again, until nothing is left over: samples are drawn from the remainder, which
shrinks by the clusters each sample meets.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawloom.llm.drawings import WIDTH, unit, unpack
from drawloom.llm.storage import stored


@dataclass
class Parameters:
    """Bounds and widths; none of them depends on the size of the data."""

    similarity: float = 0.71  #: least cosine of a drawing to the representative of its cell
    projections: int = 64
    #: Distances between unit vectors that the levels are made for; a window reaches half of it to either side.
    radii: tuple[float, ...] = (0.5, 0.62, 0.76, 0.95)
    threshold: int = 18  #: collisions of 64 from which a representative is verified
    sample: int = 4096  #: drawings a round that representatives are chosen from
    rounds: int = 12  #: rounds after which a warning tells that representatives go on growing with the data
    grid: int = 512  #: prefixes kept of each sorted order
    border: float = 0.6  #: a drawing is also a guest of further cells whose representative is this near
    near_cells: float = 0.5  #: representatives this near make their cells neighbours
    seed: int = 11


@dataclass
class Index:
    reps: np.ndarray  #: unit vectors of the representatives
    ids: np.ndarray  #: their row_ids
    p: Parameters = field(default_factory=Parameters)

    def __post_init__(self):
        rng = np.random.default_rng(self.p.seed)
        self.planes = rng.standard_normal((WIDTH, self.p.projections)).astype(np.float32)

    def __getstate__(self):
        return {"reps": self.reps, "ids": self.ids, "p": self.p}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def tables(self):
        """For every projection the sorted values at the grid, and the prefixes' bitsets."""
        if not hasattr(self, "_tables"):
            n = len(self.reps)
            words = -(-n // 64)
            step = max(1, -(-n // self.p.grid))
            cuts = np.arange(0, n + step, step).clip(max=n)
            values = self.reps @ self.planes
            made = []
            for j in range(self.p.projections):
                order = np.argsort(values[:, j], kind="stable")
                bits = np.zeros((len(cuts), words * 64), np.uint8)
                for k in range(1, len(cuts)):
                    bits[k] = bits[k - 1]
                    bits[k, order[cuts[k - 1] : cuts[k]]] = 1
                made.append((values[order, j], np.packbits(bits, axis=1, bitorder="little").view(np.uint64)))
            self._tables = step, made
        return self._tables

    def colliding(self, projected: np.ndarray, half: float) -> np.ndarray:
        """A bit for every (query, representative) that shares at least `threshold` windows."""
        step, tables = self.tables
        last = tables[0][1].shape[0] - 1
        planes: list[list[np.ndarray]] = [[]]
        for j, (values, prefix) in enumerate(tables):
            lo = np.searchsorted(values, projected[:, j] - half, "left") // step
            hi = -(-np.searchsorted(values, projected[:, j] + half, "right") // step)
            planes[0].append(prefix[hi.clip(max=last)] ^ prefix[lo])
            # full adders: three of one weight become one of it and one of twice the weight
            level = 0
            while level < len(planes) and len(planes[level]) >= 3:
                a, b, c = planes[level].pop(), planes[level].pop(), planes[level].pop()
                ab = a ^ b
                if level + 1 == len(planes):
                    planes.append([])
                planes[level].append(ab ^ c)
                planes[level + 1].append((a & b) | (ab & c))
                level += 1
        level = 0
        while level < len(planes):
            while len(planes[level]) > 1:
                a, b = planes[level].pop(), planes[level].pop()
                if level + 1 == len(planes):
                    planes.append([])
                planes[level].append(a ^ b)
                planes[level + 1].append(a & b)
            level += 1
        zero = np.zeros_like(tables[0][1][:1]).repeat(len(projected), 0)
        above, equal = zero, ~zero
        for k in range(max(len(planes), self.p.threshold.bit_length()) - 1, -1, -1):
            plane = planes[k][0] if k < len(planes) and planes[k] else zero
            if self.p.threshold >> k & 1:
                equal = equal & plane
            else:
                above = above | (equal & plane)
                equal = equal & ~plane
        return above | equal

    def nearest(self, u: np.ndarray, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Position and cosine of the nearest representative found for each unit vector; -1 where none is near enough."""
        least = self.p.similarity if least is None else least
        where, best = np.full(len(u), -1), np.full(len(u), -1.0, np.float32)
        for lo in range(0, len(u) if len(self.reps) else 0, 2048):
            part = u[lo : lo + 2048]
            projected = part @ self.planes
            open_ = np.arange(len(part))
            for radius in self.p.radii:
                hits = self.colliding(projected[open_], radius / 2)
                row, rep = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little", count=len(self.reps)))
                cos = np.empty(len(row), np.float32)
                for a in range(0, len(row), 256):
                    q, r = open_[row[a : a + 256]], rep[a : a + 256]
                    cos[a : a + 256] = np.einsum("ij,ij->i", part[q], self.reps[r])
                # of the verified, the nearest; the lower position among equals
                order = np.lexsort((-rep, cos))
                w, b = np.full(len(open_), -1), np.full(len(open_), -1.0, np.float32)
                w[row[order]], b[row[order]] = rep[order], cos[order]
                found = b >= least
                where[lo + open_[found]], best[lo + open_[found]] = w[found], b[found]
                open_ = open_[~found]
                if not len(open_):
                    break
        return where, best

    @property
    def neighbours(self) -> list[np.ndarray]:
        """Of each representative, the others near enough to share guests."""
        if not hasattr(self, "_neighbours"):
            out = []
            strip = strip_of(len(self.reps), 1024)
            for lo in range(0, len(self.reps), strip):
                s = self.reps[lo : lo + strip] @ self.reps.T
                s[np.arange(len(s)), lo + np.arange(len(s))] = -1
                out.extend(np.flatnonzero(r >= self.p.near_cells) for r in s)
            self._neighbours = out
        return self._neighbours

    def guests(self, u: np.ndarray, where: np.ndarray, neighbours: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of drawings near the representative of a neighbouring cell, of those of each cell that are given."""
        neighbours = self.neighbours if neighbours is None else neighbours
        rows, cells = [np.zeros(0, int)], [np.zeros(0, int)]
        for cell in np.unique(where[where >= 0]):
            others = neighbours[cell]
            if len(others):
                mine = np.flatnonzero(where == cell)
                a, b = np.nonzero(u[mine] @ self.reps[others].T >= self.p.border)
                rows.append(mine[a])
                cells.append(others[b])
        return np.concatenate(rows), np.concatenate(cells)


def strip_of(reps: int, most: int) -> int:
    """Rows that meet all representatives at a time: `most`, or fewer so that their cosines stay within 128 MB."""
    return max(1, min(most, (1 << 25) // max(reps, 1)))


def leaders(u: np.ndarray, ids: np.ndarray, similarity: float) -> np.ndarray:
    """Positions such that every vector is near one of them, greedily in the order of ids."""
    order = np.argsort(ids, kind="stable")
    out, rest = [], order
    while len(rest):
        out.append(rest[0])
        rest = rest[1:][u[rest[1:]] @ u[rest[0]] < similarity]
    return np.array(out, int)


def hash_share(column: str, share: float, seed: int):
    """True for about this share of the values, by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) < int(share * (1 << 30))


def bounded_sample(rows: DataFrame, n: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row_ids, unit vectors) of about `size` drawings chosen by hash; of all if there are no more."""
    share = min(1.0, size / max(n, 1))
    picked = rows.where(hash_share("row_id", share, seed)) if share < 1 else rows
    got = picked.select("row_id", "v").limit(2 * size).toArrow()
    ids, first = np.unique(got.column(0).to_numpy(), return_index=True)
    return ids, unit(unpack(got.column(1))[first])


@dataclass
class Cells:
    index: Index
    sizes: dict[int, int]  #: rows of each cell, repeated deliveries included
    rows: DataFrame  #: the input's columns and cell


def build(rows: DataFrame, p: Parameters | None = None, n: int | None = None) -> Cells:
    """Puts every row of `rows` (row_id, v, further columns) into a cell.

    n is the number of rows or an upper bound, to save counting rows that are
    costly to make. Rounds go on until nothing is left over; each places its
    representatives at least. Data with more separate clusters than
    rounds * sample gets as many representatives, 3 kB each in every worker,
    and a warning.
    """
    p = p or Parameters()
    index = Index(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), p)
    sizes: dict[int, int] = {}
    rest, parts = rows, []
    n = rows.count() if n is None else n
    turn = 0
    while True:
        ids, u = bounded_sample(rest, n, p.sample, p.seed + turn)
        if not len(ids):  # few row_ids, delivered often, or n far above the rows there are
            ids, u = bounded_sample(rest, 0, p.sample, p.seed + turn)
        new = leaders(u, ids, p.similarity)
        fresh, base = Index(u[new], ids[new], p), len(index.reps)
        index = Index(np.concatenate([index.reps, fresh.reps]), np.concatenate([index.ids, fresh.ids]), p)
        placed = stored(place(rest, fresh), "placed")
        parts.append(placed.where("cell >= 0").withColumn("cell", F.col("cell") + base))
        counts = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
        n = counts.pop(-1, 0)
        sizes.update({base + cell: count for cell, count in counts.items()})
        rest = placed.where("cell < 0").drop("cell")
        turn += 1
        if not n:
            break
        if turn == p.rounds:
            warnings.warn(f"{n} drawings are near none of {len(index.reps)} representatives; going on", stacklevel=2)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return Cells(index, sizes, whole)


def place(rows: DataFrame, index: Index) -> DataFrame:
    """rows with the cell of the nearest representative found, -1 where none is near enough."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    at = rows.columns.index("v")

    def run(batches):
        for batch in batches:
            where, _ = shared.value.nearest(unit(unpack(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema]).add("cell", T.IntegerType()))
