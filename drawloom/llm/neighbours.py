"""The k most similar drawings of every drawing.

Collision counting (collisions.py) finds for every drawing the representatives
it collides with often enough; the rows those stand for are verified exactly.
A cell is cut into hubs of at most about BLOCK distinct drawings by a hash of
the drawing. A task holds one hub and lets the drawings of half of the other
hubs stream past, so that every two hubs meet once and a drawing travels to one
task for every two hubs of its cell. Equal drawings are compared once.

Most pairs are ruled out by a bound on their cosine in the few directions in
which the drawings of a hub differ (`Directions`); nothing is ruled out by
estimate, and what the bound leaves is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawloom.llm.bounds import bounds_of, candidates_of
from drawloom.llm.collisions import Cells, Parameters, build
from drawloom.llm.drawings import compact, exact_cosines, unit, unpack
from drawloom.llm.storage import spread, stored

#: Distinct drawings of a hub, about: 26 MB as bytes, and four bytes for each direction kept.
BLOCK = 32_768
#: Drawings and pairs that are unpacked at a time.
UNPACKED, PAIRS = 2048, 4096
#: float32 cosines differ from exact ones by less than this; what is this near to the k-th is compared exactly.
SLACK = 8e-6
#: Drawings that directions are learnt from, and drawings of a hub below which its columns are kept as they are.
SAMPLE, PLAIN = 4096, 2048
#: Mean squared length left outside the directions, and share of drawings with ink in a column from which it is looked at.
REST, INKED = 0.0008, 0.01
#: Rows of a product of cosines, of the hub and of those that pass; rows of the hub from which first floors are taken.
STRIP, WIDE, FIRST = 512, 1024, 256


def block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A block number for each row, by a multiplicative hash of row_id: repeats of a row_id share it."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int32)


def with_guests(cells: Cells, least: float) -> tuple[DataFrame, np.ndarray]:
    """(row_id, v, cell, home) and the rows of each cell: every drawing in its cell, and as a guest in all that may hold a drawing at `least` to it.

    Which cells those are follows from angles (bounds.py), so that none is missed.
    """
    guests = stored(candidates_of(cells, bounds_of(cells, float(np.arccos(least)))), "guests")
    counts = np.array([cells.sizes.get(c, 0) for c in range(len(cells.index.reps))], np.int64)
    for r in guests.groupBy("other").count().collect():  # at most one row a cell
        counts[r.other] += r["count"]
    at_home = cells.rows.select("row_id", "v", "cell", F.lit(True).alias("home"))
    return at_home.unionByName(guests.select("row_id", "v", F.col("other").alias("cell"), F.lit(False).alias("home"))), counts


def meeting(rows: DataFrame, counts: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Rows once for every hub they take part in: (cell, hub, visits, h, row_id, v).

    A row is at home in one hub of its cell and visits half of the others: of
    every two hubs, the rows of one visit the other. Cells of one row meet
    nobody and are left out.
    """
    some = np.flatnonzero(counts > 1)
    sizes = rows.sparkSession.createDataFrame([(int(c), int(-(-counts[c] // block))) for c in some], "cell int, hubs int")
    own = rows.join(F.broadcast(sizes), "cell").withColumn("h", F.xxhash64("v")).withColumn("own", F.expr("int(pmod(h, hubs))"))
    half = "if(hubs % 2 = 0 and own >= hubs div 2, array(int(own - hubs div 2)), cast(array() as array<int>))"
    to = own.withColumn("hub", F.explode(F.expr(f"concat(transform(sequence(0, int((hubs - 1) div 2)), d -> int(pmod(own - d, hubs))), {half})")))
    return to.select("cell", "hub", (F.col("hub") != F.col("own")).alias("visits"), "h", "row_id", "v")


class Drawings:
    """Distinct drawings and the row_ids of each. Rows come ordered by h, a hash of v."""

    def __init__(self):
        self.n, self.last, self.parts, self.ids, self.of = 0, None, [], [], []

    def add(self, ids: np.ndarray, h: np.ndarray, v: pa.Array) -> Drawings:
        new = np.ones(len(ids), bool)
        new[1:] = h[1:] != h[:-1]
        for i in np.flatnonzero(~new):
            new[i] = v[i].as_py() != v[i - 1].as_py()
        new[0] = self.last != v[0].as_py()
        self.last = v[-1].as_py()
        self.parts.append(v.filter(pa.array(new)))
        self.ids.append(ids)
        self.of.append(self.n - 1 + np.cumsum(new))
        self.n += int(new.sum())
        return self

    def close(self) -> Drawings:
        ids, of = np.concatenate(self.ids), np.concatenate(self.of)
        order = np.lexsort((ids, of))
        ids, of = ids[order], of[order]
        once = np.ones(len(ids), bool)  # repeated deliveries count once
        once[1:] = (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])
        self.ids, self.of = ids[once], of[once]
        self.start = np.searchsorted(self.of, np.arange(self.n + 1))
        self.v, self.parts = pa.concat_arrays(self.parts), []
        return self

    def x(self, at: np.ndarray) -> np.ndarray:
        return unpack(self.v.take(pa.array(at)))

    def first_ids(self, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in at, row_id) of the `most` smallest row_ids of each drawing: no more of equal drawings can be among the best."""
        n = np.minimum(self.start[at + 1] - self.start[at], most)
        take = np.repeat(np.arange(len(at)), n)
        return take, self.ids[self.start[at][take] + np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)]


class Directions:
    """Coordinates in which the product of two drawings is at least their cosine, and more by little.

    The last coordinate is the length of what lies outside the directions
    kept; the products of these parts are at most those of their lengths.
    """

    def __init__(self, d: Drawings):
        u = unit(d.x(np.unique(np.linspace(0, d.n - 1, SAMPLE).astype(int))))
        self.columns = np.flatnonzero((u != 0).mean(axis=0) > INKED)
        self.basis = None
        if d.n >= PLAIN:
            inked = u[:, self.columns]
            shares, basis = np.linalg.eigh((inked.T @ inked).astype(np.float64) / len(u))
            left = np.cumsum(shares)  # from the least
            self.basis = np.ascontiguousarray(basis[:, np.searchsorted(left, REST) :], np.float32)

    def of(self, d: Drawings) -> np.ndarray:
        return np.concatenate([self.coordinates(unit(unpack(d.v[lo : lo + UNPACKED]))) for lo in range(0, d.n, UNPACKED)])

    def coordinates(self, u: np.ndarray) -> np.ndarray:
        part = u[:, self.columns]
        part = part if self.basis is None else part @ self.basis
        rest = np.sqrt((1 - np.einsum("ij,ij->i", part, part)).clip(0) + 2e-6)
        return np.concatenate([part, rest[:, None]], axis=1)


class Floors:
    """What a cosine must reach to be among the k best of each drawing, as far as is known."""

    def __init__(self, n: int, k: int, least: float):
        self.k = k
        self.top = np.full((n, k), -2, np.float32)
        self.least = np.full(n, least - SLACK, np.float32)

    def seed(self, lo: int, s: np.ndarray, place: int) -> None:
        """s: cosines, or less, of drawings from lo on with some others; the place-th best of them is a floor."""
        if s.shape[1] >= place:
            kth = np.partition(s, s.shape[1] - place, axis=1)[:, s.shape[1] - place]
            self.least[lo : lo + len(s)] = np.maximum(self.least[lo : lo + len(s)], kth - np.float32(SLACK))

    def lift(self, rows: np.ndarray, s: np.ndarray) -> None:
        """s: cosines, or less, of drawings with others that they had not met."""
        better = s > self.top[rows, 0]
        order = np.lexsort((-s[better], rows[better]))
        rows, s = rows[better][order], s[better][order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        rows, s, place = rows[place < self.k], s[place < self.k], place[place < self.k]
        these, back = np.unique(rows, return_inverse=True)
        both = np.full((len(these), 2 * self.k), -2, np.float32)
        both[:, : self.k] = self.top[these]
        both[back, self.k + place] = s
        both.sort(axis=1)
        self.top[these] = both[:, self.k :]
        self.least[these] = np.maximum(self.least[these], both[:, self.k] - np.float32(SLACK))


def marked(marks: np.ndarray, n: int) -> np.ndarray:
    """Positions of the true ones among the first n of marks, which are few: eight are looked at together."""
    marks[n : n + 8] = False
    some = np.flatnonzero(marks[: -(-n // 8) * 8].view(np.uint64))
    at = (some[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[marks[at]]


def meet(a: Drawings, pa_: np.ndarray, fa: Floors, b: Drawings, pb: np.ndarray, fb: Floors, least: float):
    """(i, j, cosine, good for i, good for j) of pairs of a's and b's drawings that may be among the best of either; each pair once where a is b.

    Cosines are rounded to six decimals.
    """
    same, k = a is b, fa.k
    found = []
    out, marks = np.empty(STRIP * WIDE, np.float32), np.zeros(STRIP * WIDE + 8, bool)
    for b0 in range(0, len(pb), WIDE):
        q = pb[b0 : b0 + WIDE]
        first = pa_[:FIRST]
        fb.seed(b0, q @ first.T - 2 * q[:, -1:] * first[:, -1], k + same)
        for a0 in range(0, min(len(pa_), b0 + WIDE) if same else len(pa_), STRIP):
            r = pa_[a0 : a0 + STRIP]
            s = np.matmul(r, q.T, out=out[: len(r) * len(q)].reshape(len(r), len(q)))
            near = np.greater_equal(s, fa.least[a0 : a0 + STRIP, None], out=marks[: s.size].reshape(s.shape))
            near |= s >= fb.least[b0 : b0 + WIDE]
            at = marked(marks, s.size)
            i, j = at // len(q), at % len(q)
            if same:
                i, j = i[i + a0 < j + b0], j[i + a0 < j + b0]
            if len(i):
                s, low = s[i, j], s[i, j] - 2 * r[i, -1] * q[j, -1]
                i, j = i + a0, j + b0
                fa.lift(i, low)
                fb.lift(j, low)
                found.append((i.astype(np.int32), j.astype(np.int32), s))
    if not found:
        return (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool), np.zeros(0, bool))
    i, j, s = (np.concatenate(c) for c in zip(*found))
    keep = (s >= fa.least[i]) | (s >= fb.least[j])
    i, j, s = i[keep], j[keep], s[keep]
    cos = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        (ai, back_i), (bj, back_j) = (np.unique(c[lo : lo + PAIRS], return_inverse=True) for c in (i, j))
        cos[lo : lo + PAIRS] = np.round(exact_cosines(a.x(ai), b.x(bj), back_i, back_j), 6)
    fine = cos >= least
    i, j, s, cos = i[fine], j[fine], s[fine], cos[fine]
    return i, j, cos, s >= fa.least[i], s >= fb.least[j]


def best(of: np.ndarray, other: np.ndarray, cos: np.ndarray, k: np.ndarray):
    """The best others of each, as many as k says for it; ties to the smaller row_id."""
    order = np.lexsort((other, -cos, of))
    of, other, cos = of[order], other[order], cos[order]
    top = np.arange(len(of)) - np.searchsorted(of, of, "left") < k[of]
    return of[top], other[top], cos[top]


def lists(d: Drawings, of: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(row_id, other, cosine): the k best others of every row of d, of those given for its drawings; one more for rows of equal drawings."""
    rows = d.start[1:] - d.start[:-1]
    of, other, cos = best(of, other, cos, k + (rows > 1))  # a row may be among those of its drawing
    for lo in range(0, len(of), 8192):
        here = of[lo : lo + 8192]
        take, mine = d.first_ids(here, len(d.ids))
        other_, cos_ = other[lo : lo + 8192][take], cos[lo : lo + 8192][take]
        for at in range(0, len(mine), 8192):
            part = np.flatnonzero(mine[at : at + 8192] != other_[at : at + 8192]) + at
            yield pa.RecordBatch.from_arrays([pa.array(mine[part]), pa.array(other_[part]), pa.array(cos_[part])], names=["row_id", "other", "cosine"])


def hub_kernel(k: int, least: float):
    """Of each row of a hub and of each that visits, the k best it met there."""

    def parts(batches):
        """(visits, row_ids, h, v) of stretches of rows that are alike in `visits`."""
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731,B023
            visits = get("visits").to_numpy(zero_copy_only=False)
            for lo, hi in ((0, int((~visits).sum())), (int((~visits).sum()), len(visits))):
                if lo < hi:
                    if visits[lo:hi].any() != visits[lo:hi].all():
                        raise RuntimeError("rows of a hub must come before those that visit it")
                    yield bool(visits[lo]), get("row_id").to_numpy()[lo:hi], get("h").to_numpy()[lo:hi], get("v").slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, kept = Drawings(), []
        ways = coords = floors = None

        def close():
            nonlocal ways, coords, floors
            home.close()
            ways = Directions(home)
            coords = ways.of(home)
            floors = Floors(home.n, k, least)
            i, j, cos, _, _ = meet(home, coords, floors, home, coords, floors, least)
            for p, q in ((i, j), (j, i)):
                take, ids = home.first_ids(q, k + 1)
                kept.append((p[take], ids, cos[take]))
            many = np.flatnonzero(home.start[1:] - home.start[:-1] > 1)
            take, ids = home.first_ids(many, k + 1)
            kept.append((many[take], ids, np.ones(len(take))))

        for visits, ids, h, v in parts(batches):
            if not visits:
                if ways is not None:
                    raise RuntimeError("rows of a hub must come before those that visit it")
                home.add(ids, h, v)
                continue
            if not home.n:
                continue  # a hub that no hash led to
            if ways is None:
                close()
            guests = Drawings().add(ids, h, v).close()
            theirs = ways.of(guests)
            i, j, cos, for_i, for_j = meet(home, coords, floors, guests, theirs, Floors(guests.n, k, least), least)
            take, ids = guests.first_ids(j[for_i], k + 1)
            kept.append((i[for_i][take], ids, cos[for_i][take]))
            take, ids = home.first_ids(i[for_j], k + 1)
            yield from lists(guests, j[for_j][take], ids, cos[for_j][take], k)
        if home.n:
            if ways is None:
                close()
            yield from lists(home, *(np.concatenate(c) for c in zip(*kept)), k)

    return run


def nearest_drawings(examples: DataFrame, k: int = 5, least: float = 0.71, p: Parameters | None = None, block: int = BLOCK) -> DataFrame:
    """(row_id, other, cosine, place): up to k most similar other drawings of every usable drawing.

    Cosines are of x as stored, in double precision, rounded to six decimals;
    ties go to the smaller row_id; neighbours below `least` are not listed.
    Unusable drawings, null row_ids and repeated deliveries never appear; an
    empty table gives an empty result.
    """
    cells = build(compact(examples), p, n=examples.count())
    if not len(cells.index.reps):
        return examples.sparkSession.createDataFrame([], "row_id bigint, other bigint, cosine double, place int")
    rows, counts = with_guests(cells, least)
    hubs = -(-counts // block)
    met = spread(meeting(rows, counts, block), int((counts * (hubs + 1) // 2).sum()), "cell", "hub").sortWithinPartitions("cell", "hub", "visits", "h")
    found = met.groupBy("cell", "hub").applyInArrow(hub_kernel(k, least), "row_id bigint, other bigint, cosine double")
    # a drawing and a guest may meet in two cells: equal rows share a rank and are counted once
    ranked = Window.partitionBy("row_id").orderBy(F.col("cosine").desc(), "other")
    return found.withColumn("place", F.dense_rank().over(ranked)).where(F.col("place") <= k).distinct()


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(row_a, row_b), the smaller first, of drawings of which at least one lists the other."""
    return neighbours.select(F.least("row_id", "other").alias("row_a"), F.greatest("row_id", "other").alias("row_b")).distinct()
