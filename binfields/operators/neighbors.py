"""Spatial joins on the integer lattice: discs, nearest neighbours, edges, boundaries, tiles with halo.

Cells sit on integer bins, so "within r" is dx*dx + dy*dy <= (r / bin)**2 and every radius join is an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfields.functions.summary import global_quantile
from binfields.operators.grid import BIN_SIZE_UM, CELL
from binfields.sources.scratch import checkpoint


def disc(radius: float, size: float = BIN_SIZE_UM) -> list[tuple[int, int]]:
    """Offsets within the closed radius, self included."""
    reach, limit = int(radius // size), (radius / size) ** 2 + 1e-9
    return [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx * dx + dy * dy <= limit]


def offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in pairs))


def radius_join(cells: DataFrame, others: DataFrame, radius: float, size: float = BIN_SIZE_UM) -> DataFrame:
    """Every column of ``others`` within the radius of each cell: x_bin, y_bin, nx, ny, d2 (bins squared), columns of others.

    For small radii: each cell is copied once for each offset and meets its neighbour by an equi-join.
    """
    around = cells.select(*CELL, F.inline(offsets(disc(radius, size)))).select(
        *CELL, (F.col("x_bin") + F.col("dx")).alias("nx"), (F.col("y_bin") + F.col("dy")).alias("ny"), (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2")
    )
    renamed = others.withColumnsRenamed({"x_bin": "nx", "y_bin": "ny"})
    return around.join(renamed, ["nx", "ny"])


# Widths of the count pyramid grow by this many bits from level to level.
_LEVEL_BITS = 3


def _count_pyramid(points: DataFrame, boxes: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """level, bx, by, n: points in each bucket that has any, and the highest level, whose buckets are as wide as all points and boxes.

    Buckets of level j are 2 ** (bits + 3 j) bins wide, so all levels together are little more than the first.
    """
    corners = points.select("x", "y").unionByName(boxes.select(F.col("x0").alias("x"), F.col("y0").alias("y")))
    box = corners.agg(*(F.coalesce(F.max(a) - F.min(a), F.lit(0)).alias(a) for a in ("x", "y"))).first()
    top = 0
    while 2 ** (bits + _LEVEL_BITS * top) <= max(box["x"], box["y"]):
        top += 1
    first = checkpoint(points.groupBy(F.shiftright("x", bits).alias("bx"), F.shiftright("y", bits).alias("by")).agg(F.count("*").alias("n")))
    levels = first.select(F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"), "bx", "by", "n")
    for a in ("bx", "by"):
        levels = levels.withColumn(a, F.expr(f"shiftright({a}, {_LEVEL_BITS} * level)"))
    return checkpoint(levels.groupBy("level", "bx", "by").agg(F.sum("n").alias("n"))), top


def _gaps(a: str, low: Column, high: Column) -> tuple[Column, Column]:
    """Least and greatest distance along one axis between a box (a0 to a1) and the bins from ``low`` to ``high``."""
    least = F.greatest(low - F.col(f"{a}1"), F.col(f"{a}0") - high, F.lit(0).cast("long"))
    return least, F.greatest(F.abs(high - F.col(f"{a}0")), F.abs(F.col(f"{a}1") - low))


def _with_gaps(rows: DataFrame, low: tuple[Column, Column], width: Column) -> DataFrame:
    """Adds near2 and far2, squared distances between the box and the bucket that begins at ``low``."""
    (nx, fx), (ny, fy) = (_gaps(a, at, at + width - 1) for a, at in zip("xy", low, strict=True))
    return rows.withColumns({"near2": nx * nx + ny * ny, "far2": fx * fx + fy * fy})


def _hopeful(rows: DataFrame, ids: Sequence[str], k: Column) -> DataFrame:
    """Buckets that may hold one of the ``k`` points nearest to any bin of the box: not beyond the distance that surely has as many."""
    own = Window.partitionBy(*ids)
    counted = rows.withColumn("_sure", F.sum("n").over(own.orderBy("far2")))
    limit = F.min(F.when(F.col("_sure") >= k, F.col("far2"))).over(own)
    return counted.withColumn("_limit", limit).filter(F.col("near2") <= F.col("_limit")).drop("_sure", "_limit")


def points_near_boxes(boxes: DataFrame, points: DataFrame, k: int, bits: int) -> DataFrame:
    """tx, ty, px, py, near2, far2: for each box of 2 ** bits bins (tx, ty) the points among which are the k nearest ones of each of its bins.

    ``points`` (x, y) are distinct. Each box starts at the smallest level of a count pyramid whose buckets around it hold k
    points, so no empty space is searched however wide it is, and goes down level by level, keeping the buckets that are
    not farther than k points surely are. Every step is an equi-join on buckets.
    """
    points = checkpoint(points.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))
    wanted = F.lit(min(k, points.count()))
    spans = {f"{a}{e}": F.shiftleft(F.col(f"t{a}").cast("long"), bits) + (2**bits - 1) * e for a in "xy" for e in (0, 1)}
    boxes = checkpoint(boxes.select(F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty")).withColumns(spans))
    pyramid, top = _count_pyramid(points, boxes, bits)
    ids = ["tx", "ty", "x0", "x1", "y0", "y1"]

    def around(rows: DataFrame, reach: int) -> DataFrame:
        """The buckets of the row's level around the box."""
        steps = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]
        spread = rows.select("*", F.inline(offsets(steps)))
        return spread.withColumns({"bx": F.expr(f"shiftright(tx, {_LEVEL_BITS} * level)") + F.col("dx"), "by": F.expr(f"shiftright(ty, {_LEVEL_BITS} * level)") + F.col("dy")}).drop("dx", "dy")

    tried = around(boxes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))), 1).join(pyramid, ["level", "bx", "by"])
    enough = tried.groupBy(*ids, "level").agg(F.sum("n").alias("n")).filter(F.col("n") >= wanted)
    begun = checkpoint(enough.groupBy(*ids).agg(F.min("level").alias("level")))
    highest = begun.agg(F.max("level").alias("m")).first()["m"]
    frontier = None
    for level in range(-1 if highest is None else highest, -1, -1):
        width = 2 ** (bits + _LEVEL_BITS * level)
        # points beyond the three buckets around are farther than those inside surely are
        start = around(begun.filter(F.col("level") == level), 3).join(pyramid.filter(F.col("level") == level).drop("level"), ["bx", "by"]).select(*ids, "bx", "by", "n")
        rows = start if frontier is None else frontier.unionByName(start)
        kept = checkpoint(_hopeful(_with_gaps(rows, (F.col("bx") * width, F.col("by") * width), F.lit(width)), ids, wanted).select(*ids, "bx", "by"))
        if level:
            down = pyramid.filter(F.col("level") == level - 1).select("bx", "by", "n")
            inner = down.withColumns({"_px": F.shiftright("bx", _LEVEL_BITS), "_py": F.shiftright("by", _LEVEL_BITS)})
            frontier = kept.withColumnsRenamed({"bx": "_px", "by": "_py"}).join(inner, ["_px", "_py"]).select(*ids, "bx", "by", "n")
        else:
            inner = points.withColumns({"bx": F.shiftright("x", bits), "by": F.shiftright("y", bits), "n": F.lit(1).cast("long")})
            met = _with_gaps(kept.join(inner, ["bx", "by"]), (F.col("x"), F.col("y")), F.lit(1))
            return _hopeful(met, ids, wanted).select("tx", "ty", F.col("x").alias("px"), F.col("y").alias("py"), "near2", "far2")
    return boxes.select("tx", "ty", *(F.lit(0).cast("long").alias(c) for c in ("px", "py", "near2", "far2"))).limit(0)


def knn_join(cells: DataFrame, k: int = 8, first_reach: int = 3) -> DataFrame:
    """The k nearest other cells: x_bin, y_bin, nx, ny, d2, rank. Ties go by nx, ny.

    A cell with k neighbours inside a small disc is settled, as all others are farther; the rest go to the level of a
    count pyramid that holds enough cells (``points_near_boxes``), however far these are.
    """
    cells = checkpoint(cells.select(*CELL))
    by_distance = Window.partitionBy(*CELL).orderBy("d2", "nx", "ny")
    near = radius_join(cells, cells, first_reach, 1.0).filter("d2 > 0").withColumn("d2", F.col("d2").cast("long"))
    ranked = near.withColumn("rank", F.row_number().over(by_distance)).withColumn("_n", F.count("*").over(Window.partitionBy(*CELL)))
    settled = checkpoint(ranked.filter((F.col("rank") <= k) & (F.col("_n") >= k)).drop("_n"))
    open_ = checkpoint(cells.join(settled.filter("rank = 1").select(*CELL), list(CELL), "left_anti"))
    if open_.isEmpty():
        return settled
    names = dict(zip(CELL, ("tx", "ty"), strict=True))
    # a box of one bin; its own cell is the nearest of k + 1
    found = points_near_boxes(open_.withColumnsRenamed(names), cells.withColumnsRenamed({"x_bin": "x", "y_bin": "y"}), k + 1, 0).filter("near2 > 0")
    far = found.select(*(F.col(t).cast("int").alias(c) for c, t in names.items()), F.col("px").cast("int").alias("nx"), F.col("py").cast("int").alias("ny"), F.col("near2").alias("d2"))
    return settled.unionByName(far.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k))


def lattice_edges(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """Undirected edges between existing neighbours, once each: x_bin, y_bin, nx, ny."""
    half = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    out = cells.select(*CELL, F.inline(offsets(half))).select(*CELL, (F.col("x_bin") + F.col("dx")).alias("nx"), (F.col("y_bin") + F.col("dy")).alias("ny"))
    return out.join(cells.select(F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny")), ["nx", "ny"]).select(*CELL, "nx", "ny")


def edge_similarity(edges: DataFrame, cells: DataFrame, features: str = "features") -> DataFrame:
    """Adds the weight exp(-d*d / tau**2) of each edge, d the feature distance and tau the median positive distance."""
    left = cells.select(*CELL, F.col(features).alias("_a"))
    right = cells.select(F.col("x_bin").alias("nx"), F.col("y_bin").alias("ny"), F.col(features).alias("_b"))
    squares = F.aggregate(F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = edges.join(left, list(CELL)).join(right, ["nx", "ny"]).select(*CELL, "nx", "ny", squares.alias("_d2"))
    far = checkpoint(far)
    middle = global_quantile(far.filter("_d2 > 0").select(F.sqrt("_d2").alias("_d")), "_d", 0.5).first()["quantile"]
    tau = max(1.0 if middle is None else middle, 1e-6)
    return far.select(*CELL, "nx", "ny", F.exp(-F.col("_d2") / F.lit(tau * tau)).alias("w"))


def boundary_cells(cells: DataFrame, region: str = "region", radius: float = 30.0, size: float = BIN_SIZE_UM) -> DataFrame:
    """Cells with a cell of another region within the radius."""
    near = radius_join(cells, cells.select(*CELL, F.col(region).alias("_other")), radius, size)
    mixed = near.join(cells.select(*CELL, F.col(region).alias("_own")), list(CELL)).filter("_own <> _other")
    return cells.join(mixed.select(*CELL), list(CELL), "left_semi")


def _tile_distances(cells: pa.Table, ends: pa.Table) -> pa.Table:
    """Squared distance of each cell of a tile to the nearest of ``ends``: within each column first, then across columns."""
    x, y = (cells.column(c).to_numpy().astype(np.int64) for c in CELL)
    bx, by = (ends.column(c).to_numpy().astype(np.int64) for c in ("px", "py"))
    out = np.full(len(x), np.iinfo(np.int64).max)
    if len(x) and len(bx):
        order = np.argsort(bx, kind="stable")
        columns, begin = np.unique(bx[order], return_index=True)
        rows, row = np.unique(y, return_inverse=True)
        gap = np.minimum.reduceat((by[order][:, None] - rows) ** 2, begin, axis=0)
        places, place = np.unique(x, return_inverse=True)
        best = np.full((len(places), len(rows)), np.iinfo(np.int64).max)
        for some in range(0, len(columns), 64):
            across = (places[:, None] - columns[some : some + 64]) ** 2
            best = np.minimum(best, (across[:, :, None] + gap[some : some + 64]).min(1))
        out = best[place, row]
    return pa.table({"x_bin": cells.column("x_bin"), "y_bin": cells.column("y_bin"), "d2": pa.array(out)})


def nearest_boundary(cells: DataFrame, boundary: DataFrame, tile_bits: int = 6) -> DataFrame:
    """x_bin, y_bin, d2: squared distance (in bins) to the nearest boundary cell; null without any.

    Tiles of 2 ** tile_bits bins find the boundary cells that any of their cells may be nearest to
    (``points_near_boxes``); inside a tile the distance is separable, the nearest row of each boundary column first, then the
    nearest column, so the work follows the cells and not the distance.
    """
    ends = checkpoint(boundary.select(F.col("x_bin").alias("x"), F.col("y_bin").alias("y")).distinct())
    if ends.isEmpty():
        return cells.select(*CELL, F.lit(None).cast("long").alias("d2"))
    tiles = {t: F.shiftright(c, tile_bits).cast("long") for t, c in zip(("tx", "ty"), CELL, strict=True)}
    placed = cells.select(*CELL).withColumns(tiles)
    near = points_near_boxes(placed.select("tx", "ty").distinct(), ends, 1, tile_bits).select("tx", "ty", "px", "py")
    return placed.groupBy("tx", "ty").cogroup(near.groupBy("tx", "ty")).applyInArrow(_tile_distances, "x_bin int, y_bin int, d2 long")


def signed_distance(cells: DataFrame, negative: str, positive: str, *, region: str = "region", radius: float = 30.0, size: float = BIN_SIZE_UM) -> DataFrame:
    """Cells of both regions with is_boundary and signed_dist_um: distance to the nearest boundary cell, negative in the first region."""
    both = checkpoint(cells.filter(F.col(region).isin(negative, positive)))
    edge = checkpoint(boundary_cells(both, region, radius, size).select(*CELL))
    flagged = both.join(edge.withColumn("is_boundary", F.lit(True)), list(CELL), "left").na.fill({"is_boundary": False})
    distance = F.sqrt(F.col("d2").cast("double")) * size
    near = nearest_boundary(both, edge)
    return flagged.join(near, list(CELL)).withColumn("signed_dist_um", F.when((F.col(region) == negative) & (F.col("d2") > 0), -distance).otherwise(distance)).drop("d2")


def with_halo(cells: DataFrame, tile_bins: int, halo: int) -> DataFrame:
    """Every cell in its own tile (core) and in the tiles that it lies within ``halo`` bins of: adds tile_x, tile_y, core.

    A tile has ``tile_bins``**2 core cells at most, so no tile is hot.
    """
    ranges = {a: F.sequence(F.floor((F.col(f"{a}_bin") - halo) / tile_bins), F.floor((F.col(f"{a}_bin") + halo) / tile_bins)) for a in "xy"}
    spread = cells.withColumn("tile_x", F.explode(ranges["x"])).withColumn("tile_y", F.explode(ranges["y"]))
    core = (F.floor(F.col("x_bin") / tile_bins) == F.col("tile_x")) & (F.floor(F.col("y_bin") / tile_bins) == F.col("tile_y"))
    return spread.withColumn("core", core)
