"""Iterated conditional modes by tile: many runs of label smoothing over one lattice, advanced together.

A tile holds its cells and all runs' labels as arrays, with a ring of one cell of its neighbours. It sweeps inside itself,
cells of one colour (x % 2, y % 2) at a time, until nothing changes. Tiles of one colour are not adjacent, so they move
together without raising the energy; then the next colour gets their new rings. So there is one shuffle for each tile
colour, of a quarter of the cells and of rings of labels, however many runs, labels and sweeps there are.

Cells: keys, x_bin, y_bin, unary (energy of each label), labels (one for each run; -1 where a run leaves the cell out).
Edges join neighbours of the lattice (eight of them at most), each once; those with an end that a run leaves out do not
count in it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binfields.operators.grid import CELL
from binfields.operators.neighbors import with_halo
from binfields.sources.scratch import checkpoint

TILE_BINS = 64
#: Half of the eight neighbours; the others are their opposites.
STEPS = ((1, 0), (0, 1), (1, 1), (1, -1))
_MOST = 4_000_000


def forward_weights(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x_bin, y_bin, near: weights of the edges to the four neighbours of STEPS."""
    back = F.struct((F.col("nx") - F.col("x_bin")).alias("dx"), (F.col("ny") - F.col("y_bin")).alias("dy"))
    named = edges.select(*keys, *CELL, "nx", "ny", F.col("w").cast("double").alias("w"), back.alias("d"))
    turned = (F.col("d.dx") < 0) | ((F.col("d.dx") == 0) & (F.col("d.dy") < 0))
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(CELL, ("nx", "ny"), strict=True)]
    one = named.select(*keys, *ends, "w", F.abs("d.dx").alias("dx"), F.when(turned, -F.col("d.dy")).otherwise(F.col("d.dy")).alias("dy"))
    sums = [F.coalesce(F.sum(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("w"))), F.lit(0.0)) for dx, dy in STEPS]
    return one.groupBy(*keys, *CELL).agg(F.array(*sums).alias("near"))


def _lists(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Tile:
    """Rasters of a tile with its ring: labels (run, x, y), unary (label, x, y), weights to eight neighbours (x, y)."""

    def __init__(self, tile: pa.Table, bins: int):
        core = tile.column("core").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        x, y, tx, ty = (tile.column(c).combine_chunks().to_numpy().astype(np.int64) for c in (*CELL, "tile_x", "tile_y"))
        at = (x - tx * bins + 1, y - ty * bins + 1)
        runs = len(tile.column("labels")[0])
        self.own = tile.filter(pa.array(core))
        k = len(self.own.column("unary")[0])
        self.at, shape = tuple(a[core] for a in at), (bins + 2, bins + 2)
        self.labels = np.full((runs, *shape), -1, np.int32)
        self.labels[:, at[0], at[1]] = _lists(tile, "labels", runs).T
        self.core = np.zeros(shape, bool)
        self.core[self.at] = True
        self.unary = np.zeros((k, *shape))
        self.unary[:, self.at[0], self.at[1]] = _lists(self.own, "unary", k).T
        self.forward = np.zeros((4, *shape))
        self.forward[:, at[0], at[1]] = _lists(tile, "near", 4).T

    def around(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Each of the eight steps with the weights of the cells' edges along it; inner cells only."""
        for (dx, dy), w in zip(STEPS, self.forward, strict=True):
            yield dx, dy, w
            yield -dx, -dy, np.roll(w, (dx, dy), (0, 1))

    def sweep(self, weights: np.ndarray, sweeps: int) -> np.ndarray:
        """Moves labels until nothing changes or ``sweeps`` are over; how many runs moved each cell."""
        moved, around, (k, n, _) = np.zeros(self.core.shape, np.int64), list(self.around()), self.unary.shape
        step = max(1, _MOST // (k * (n // 2) ** 2))
        for begin in range(0, len(self.labels), step):
            labels, lam = self.labels[begin : begin + step], weights[begin : begin + step, None, None, None]
            for _ in range(sweeps):
                changed = False
                for ox in (0, 1):
                    for oy in (0, 1):
                        xs, ys = slice(1 + ox, n - 1, 2), slice(1 + oy, n - 1, 2)
                        now, here = labels[:, xs, ys], self.core[xs, ys]
                        gain = np.zeros((len(labels), k, *here.shape))
                        total = np.zeros((len(labels), *here.shape))
                        for dx, dy, w in around:
                            near, w = labels[:, 1 + ox + dx : n - 1 + dx : 2, 1 + oy + dy : n - 1 + dy : 2], w[xs, ys]
                            total += w * (near >= 0)
                            for label in range(k):
                                gain[:, label] += w * (near == label)
                        cost = self.unary[:, xs, ys] + lam * (total[:, None] - gain)
                        best = cost.argmin(1)
                        own = np.take_along_axis(cost, np.maximum(now, 0)[:, None], 1)[:, 0]
                        # a tie keeps the label a cell has
                        go = here & (now >= 0) & (own > cost.min(1))
                        if go.any():
                            changed = True
                            now[go] = best[go]
                            moved[xs, ys] += go.sum(0)
                if not changed:
                    break
        return moved[self.at]

    def energies(self) -> np.ndarray:
        """Sum of unary energies, weight of cut edges and of all edges of each run; an edge counts where it begins."""
        own = self.labels[:, self.at[0], self.at[1]]
        costs = self.unary[:, self.at[0], self.at[1]]
        out = np.zeros((len(own), 3))
        out[:, 0] = np.where(own >= 0, np.take_along_axis(costs, np.maximum(own, 0), 0), 0).sum(1)
        for (dx, dy), w in zip(STEPS, self.forward, strict=True):
            w = w[self.at]
            far = self.labels[:, self.at[0] + dx, self.at[1] + dy]
            both = (own >= 0) & (far >= 0)
            out[:, 1] += (w * (both & (own != far))).sum(1)
            out[:, 2] += (w * both).sum(1)
        return out


def _key_values(key: tuple, n: int) -> tuple:
    return tuple(k.as_py() for k in key[:n])


class TileRuns:
    """The runs' state: one table of cells for each tile colour, written after each move."""

    def __init__(self, cells: DataFrame, edges: DataFrame, weights: Mapping[tuple, Sequence[float]], *, keys: Sequence[str] = (), edge_keys: Sequence[str] = (), tile_bins: int = TILE_BINS):
        """``weights`` has the smoothing weight of each run, by the values of ``keys``; edges may lack some of these."""
        self.keys, self.bins, self.weights = list(keys), tile_bins, {k: np.array(v, float) for k, v in weights.items()}
        near = forward_weights(edges, edge_keys)
        own = cells.select(*keys, *CELL, "unary", F.col("labels").cast("array<int>").alias("labels")).join(near, [*edge_keys, *CELL], "left")
        placed = own.withColumn("near", F.coalesce("near", F.array(*[F.lit(0.0)] * 4))).withColumn("tile_x", F.floor(F.col("x_bin") / tile_bins)).withColumn("tile_y", F.floor(F.col("y_bin") / tile_bins))
        placed = checkpoint(placed.withColumn("moved", F.lit(0).cast("long")))
        colour = F.pmod("tile_x", F.lit(2)) * 2 + F.pmod("tile_y", F.lit(2))
        there = sorted(r["c"] for r in placed.select(colour.alias("c")).distinct().collect())
        self.colours = {c: placed.filter(colour == c) for c in there}

    def _ring(self, c: int | None) -> DataFrame | None:
        """Cells of other tiles beside the tiles of colour ``c`` (None: of any colour), by the tile they are beside."""
        colour, out = F.pmod("tile_x", F.lit(2)) * 2 + F.pmod("tile_y", F.lit(2)), None
        for d, rows in self.colours.items():
            if d != c and len(self.colours) > 1:
                edge = [F.pmod(a, F.lit(self.bins)).isin(0, self.bins - 1) for a in CELL]
                ring = with_halo(rows.filter(edge[0] | edge[1]).drop("tile_x", "tile_y"), self.bins, 1).filter(~F.col("core"))
                ring = (ring if c is None else ring.filter(colour == c)).withColumn("unary", F.lit(None).cast("array<double>"))
                out = ring if out is None else out.unionByName(ring)
        return out

    def _by_tile(self, own: DataFrame, ring: DataFrame | None):
        rows = own.withColumn("core", F.lit(True))
        return (rows if ring is None else rows.unionByName(ring)).groupBy(*self.keys, "tile_x", "tile_y")

    def run(self, sweeps: int, rounds: int | None = None) -> TileRuns:
        """Rounds over the tile colours until no cell moves, ``rounds`` (default: ``sweeps``) at most."""
        bins, n_keys, weights = self.bins, len(self.keys), self.weights

        def sweep(key: tuple, tile: pa.Table) -> pa.Table:
            if not any(tile.column("core").to_pylist()):
                return tile.drop_columns(["core"]).slice(0, 0)
            own = _Tile(tile, bins)
            moved = own.sweep(weights[_key_values(key, n_keys)], sweeps)
            labels = np.ascontiguousarray(own.labels[:, own.at[0], own.at[1]].T)
            starts = pa.array(np.arange(len(labels) + 1, dtype=np.int32) * labels.shape[1])
            out = own.own.drop_columns(["core"])
            out = out.set_column(out.schema.get_field_index("labels"), "labels", pa.ListArray.from_arrays(starts, pa.array(labels.ravel())))
            return out.set_column(out.schema.get_field_index("moved"), "moved", pa.array(moved))

        for _ in range(rounds or sweeps):
            moves = 0
            for c, rows in self.colours.items():
                made = self._by_tile(rows, self._ring(c))
                self.colours[c] = checkpoint(made.applyInArrow(sweep, rows.schema))
                moves += self.colours[c].agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("n")).first()["n"]
            # tiles of one colour alone have no neighbours to learn from
            if not moves or len(self.colours) == 1:
                break
        return self

    def cells(self) -> DataFrame:
        """keys, x_bin, y_bin, labels."""
        out = None
        for rows in self.colours.values():
            own = rows.select(*self.keys, *CELL, "labels")
            out = own if out is None else out.unionByName(own)
        return out

    def energies(self) -> DataFrame:
        """keys, run, data_energy, cut, edge_weight."""
        bins, n_keys = self.bins, len(self.keys)
        every = None
        for rows in self.colours.values():
            every = rows if every is None else every.unionByName(rows)
        kinds = [every.schema[k] for k in self.keys]
        schema = T.StructType([*kinds, T.StructField("run", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("data_energy", "cut", "edge_weight"))])

        def add(key: tuple, tile: pa.Table) -> pa.Table:
            sums = _Tile(tile, bins).energies() if any(tile.column("core").to_pylist()) else np.zeros((0, 3))
            columns = [pa.array([k.as_py()] * len(sums), k.type) for k in key[:n_keys]]
            return pa.table([*columns, pa.array(np.arange(len(sums), dtype=np.int32)), *(pa.array(sums[:, j]) for j in range(3))], names=schema.names)

        by_tile = self._by_tile(every, self._ring(None)).applyInArrow(add, schema)
        return by_tile.groupBy(*self.keys, "run").agg(*(F.sum(n).alias(n) for n in schema.names[-3:]))


def pair_tables(rows: DataFrame, keys: Sequence[str], groups: Mapping[tuple, Sequence[Sequence[int]]], n_labels: int) -> DataFrame:
    """keys, group, pair, a, b, n: how many cells have label a in one run and b in another, for all pairs of runs of a group.

    ``rows`` has the keys and labels; ``groups`` has, by key values, lists of runs. Tasks add up the pairs of their rows,
    so only counts are shuffled, whatever the number of cells.
    """
    n_keys = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(n_keys).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = [tuple(r) for r in zip(*(batch.column(j).to_pylist() for j in range(n_keys)), strict=True)] if n_keys else [()] * batch.num_rows
            for key in set(names):
                own = labels[[k == key for k in names]] if n_keys else labels
                for g, runs in enumerate(groups[key]):
                    # a product of indicator columns holds the tables of all pairs
                    flags = (own[:, list(runs), None] == np.arange(n_labels)).reshape(len(own), -1).astype(np.float64)
                    sums[key, g] = sums.get((key, g), 0) + flags.T @ flags
        out = [[] for _ in range(n_keys + 5)]
        for (key, g), table in sums.items():
            for i, j in zip(*np.nonzero(table), strict=True):
                p, q = i // n_labels, j // n_labels
                if p < q:
                    for column, v in zip(out, (*key, g, int(p * len(groups[key][g]) + q), int(i % n_labels), int(j % n_labels), int(table[i, j])), strict=True):
                        column.append(v)
        kinds = [batch_type(f) for f in schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=schema.names)

    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, T.IntegerType()) for n in ("group", "pair", "a", "b")), T.StructField("n", T.LongType())])

    def batch_type(field: T.StructField) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(field.dataType)

    counted = rows.select(*keys, F.col("labels").cast("array<int>").alias("labels")).mapInArrow(count, schema)
    return counted.groupBy(*keys, "group", "pair", "a", "b").agg(F.sum("n").alias("n"))
