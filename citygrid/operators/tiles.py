"""Frames, pixels and tiles as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sigmoid, utm, utm_back, utm_epsg


def snapped(boxes: DataFrame, res: float) -> DataFrame:
    """boxes(minx, miny, maxx, maxy, ...) snapped outward to whole multiples of res, with width and height in cells."""
    lo = lambda c: (F.floor(F.col(c) / res) * res).cast("double").alias(c)
    hi = lambda c: (F.ceil(F.col(c) / res) * res).cast("double").alias(c)
    edges = ("minx", "miny", "maxx", "maxy")
    s = boxes.select(*[c for c in boxes.columns if c not in edges], lo("minx"), lo("miny"), hi("maxx"), hi("maxy"))
    return s.withColumns({"width": F.round((F.col("maxx") - F.col("minx")) / res).cast("long"), "height": F.round((F.col("maxy") - F.col("miny")) / res).cast("long")})


def ratio(coarse: float, fine: float) -> int:
    k = round(coarse / fine)
    if k < 1 or abs(coarse / fine - k) > 1e-9:
        raise ValueError(f"coarse resolution ({coarse}) must be a whole multiple of fine ({fine})")
    return k


def frame_pair(boxes: DataFrame, fine: float, coarse: float) -> DataFrame:
    """Coarse frames and, of the same extent, the fine ones: fine_width and fine_height are exact multiples."""
    k = ratio(coarse, fine)
    return snapped(boxes, coarse).withColumns({"fine_width": F.col("width") * k, "fine_height": F.col("height") * k})


def nested(cells: DataFrame, factor: int) -> DataFrame:
    """cells(row, col, ...) with prow and pcol: a row for each of the factor x factor pixels of a cell."""
    k = F.sequence(F.lit(0), F.lit(factor - 1))
    p = cells.select("*", F.explode(k).alias("_i")).select("*", F.explode(k).alias("_j"))
    return p.withColumns({"prow": F.col("row") * factor + F.col("_i"), "pcol": F.col("col") * factor + F.col("_j")}).drop("_i", "_j")


def pixel_cell(x: Column, y: Column, minx: float, maxy: float, res: float, rows: int, cols: int) -> tuple[Column, Column]:
    """Row and column of the cell with a pixel's centre, null outside."""
    r, c = F.floor((maxy - y) / res), F.floor((x - minx) / res)
    ok = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
    return F.when(ok, r), F.when(ok, c)


def to_cells(pixels: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """(row, col, n, mean) of pixels(row, col, ...); pixels of no cell are left out, a weight of 0 in all gives null."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    g = pixels.where("row IS NOT NULL AND col IS NOT NULL").groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(value * w).alias("s"), F.sum(w).alias("w"))
    return g.select("row", "col", "n", F.try_divide("s", "w").alias("mean"))


def mostly(pixels: DataFrame, flag: Column, share: float = 0.5) -> DataFrame:
    """(row, col, flag): whether more than the share of a cell's pixels is flagged."""
    return to_cells(pixels, flag.cast("double")).select("row", "col", (F.col("mean") > share).alias("flag"))


def origins(spark, rows: int, cols: int, size: int, stride: int) -> DataFrame:
    """(row, col) of tiles' corners, the last ones moved back so that the edges are covered."""
    if size > rows or size > cols:
        raise ValueError(f"tile {size} does not fit in a {rows} x {cols} frame")

    def line(n: int, name: str) -> DataFrame:
        long = lambda x: F.lit(x).cast("long")
        at = F.array_distinct(F.concat(F.sequence(long(0), long(n - size), long(stride)), F.array(long(n - size))))
        return spark.range(1).select(F.explode(at).alias(name))

    return line(rows, "row").crossJoin(F.broadcast(line(cols, "col")))


def covered(tiles: DataFrame, size: int) -> DataFrame:
    """(tile_row, tile_col, row, col): the cells of each tile."""
    k = F.sequence(F.lit(0), F.lit(size - 1))
    t = tiles.select(F.col("row").alias("tile_row"), F.col("col").alias("tile_col"), F.explode(k).alias("i")).select("*", F.explode(k).alias("j"))
    return t.select("tile_row", "tile_col", (F.col("tile_row") + F.col("i")).alias("row"), (F.col("tile_col") + F.col("j")).alias("col"))


def select_tiles(tiles: DataFrame, mask: DataFrame, size: int) -> DataFrame:
    """(row, col, side): tiles wholly inside the mask's cells (val) or wholly outside (train); those across its edge are in neither."""
    n = covered(tiles, size).join(mask.select("row", "col", F.lit(1).alias("in")), ["row", "col"], "left").groupBy("tile_row", "tile_col").agg(F.count("in").alias("inside"))
    side = F.when(F.col("inside") == size * size, "val").when(F.col("inside") == 0, "train")
    return n.select(F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), side.alias("side")).where("side IS NOT NULL")


def symmetry(row: Column, col: Column, k: Column, n: int) -> tuple[Column, Column]:
    """A cell's place after one of the eight symmetries of an n x n square: k % 4 quarter turns against the clock, mirrored from 4 on."""
    turn = k % 4
    r = F.when(turn == 0, row).when(turn == 1, n - 1 - col).when(turn == 2, n - 1 - row).otherwise(col)
    c = F.when(turn == 0, col).when(turn == 1, row).when(turn == 2, n - 1 - col).otherwise(n - 1 - row)
    return r, F.when(k >= 4, n - 1 - c).otherwise(c)


def overlap_average(scored: DataFrame, logit: str = "logit") -> DataFrame:
    """(row, col, n, p) of the logits that overlapping tiles give a cell: their mean's chance."""
    g = scored.groupBy("row", "col").agg(F.count("*").alias("n"), F.avg(logit).alias("m"))
    return g.select("row", "col", "n", sigmoid(F.col("m")).alias("p"))


def large_blocks(cells: DataFrame, least: int) -> DataFrame:
    """(block): blocks that span at least `least` rows and columns."""
    span = lambda c: F.max(c) - F.min(c) + 1
    return cells.groupBy("block").agg(span("row").alias("h"), span("col").alias("w")).where((F.col("h") >= least) & (F.col("w") >= least)).select("block")


def in_polygons(points: DataFrame, edges: DataFrame, step: float) -> DataFrame:
    """(poly, id) of points(id, x, y) inside polygons given by edges(poly, x1, y1, x2, y2), by crossing numbers.

    An edge meets only the points in the strips of width `step` that it spans in y; a point on a crossing counts for the lower end.
    """
    strip = F.explode(F.sequence(F.floor(F.least("y1", "y2") / step), F.floor(F.greatest("y1", "y2") / step)))
    e = edges.select("poly", "x1", "y1", "x2", "y2", strip.alias("strip"))
    p = points.select("id", "x", "y", F.floor(F.col("y") / step).alias("strip"))
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    left = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hit = p.join(e, "strip").where(spans).where(left)
    return hit.groupBy("poly", "id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("poly", "id")


def cell_shares(edges: DataFrame, rows: int, cols: int) -> DataFrame:
    """(poly, row, col, share): the exact share of each unit cell that is inside simple polygons given by edges(poly, x1, y1, x2, y2), where it isn't 0.

    An edge is cut at the rows of cells. In a row, it gives each cell from the polygon's left end on the area between the cell's left
    side and the edge, with the sign of its direction; over all edges these add up to what is inside. Work grows with the cells
    that polygons cover times the edges that a row of cells crosses.
    """
    left = edges.groupBy("poly").agg(F.greatest(F.lit(0), F.floor(F.min(F.least("x1", "x2")))).alias("first"))
    up = F.col("y2") > F.col("y1")
    at = lambda c, d: F.when(up, F.col(c)).otherwise(F.col(d))
    e = edges.where("y1 <> y2").select("poly", F.when(up, -1.0).otherwise(1.0).alias("sign"), at("x1", "x2").alias("xa"), at("y1", "y2").alias("ya"), at("x2", "x1").alias("xb"), at("y2", "y1").alias("yb"))
    first, last = F.greatest(F.lit(0), F.floor("ya")), F.least(F.lit(rows - 1), F.ceil("yb") - 1)
    e = e.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("row")).withColumns({"lo": F.greatest(F.col("ya"), F.col("row").cast("double")), "hi": F.least(F.col("yb"), F.col("row") + 1.0)})
    x = lambda y: F.col("xa") + (F.col("xb") - F.col("xa")) * (F.col(y) - F.col("ya")) / (F.col("yb") - F.col("ya"))
    e = e.select("poly", "sign", "row", (F.col("hi") - F.col("lo")).alias("dy"), x("lo").alias("u"), x("hi").alias("w")).join(left, "poly")
    right = F.least(F.lit(cols - 1), F.floor(F.greatest("u", "w")))
    e = e.where(F.col("first") <= right).select("poly", "row", "sign", "dy", "u", "w", F.explode(F.sequence("first", right)).alias("col"))
    u, w = F.col("u") - F.col("col"), F.col("w") - F.col("col")
    upto = lambda z: F.when(z <= 0, 0.0).when(z >= 1, z - 0.5).otherwise(z * z / 2)
    mean = F.when(F.abs(w - u) < 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (u + w) / 2))).otherwise((upto(w) - upto(u)) / (w - u))
    area = e.groupBy("poly", "row", "col").agg(F.abs(F.sum(F.col("sign") * F.col("dy") * mean)).alias("share"))
    return area.where("share > 1e-9")


KM_PER_DEGREE = 111.32


def areas_of_interest(boundaries: DataFrame, key: str, side_km: float = 80.0) -> DataFrame:
    """(key, epsg, buffer_km, lon0, lat0, lon1, lat1) of boundaries(key, lon0, lat0, lon1, lat1): a margin of 0.15 of the longer side, 3 to 8 km, and no more than side_km around the middle."""
    lon, lat = (F.col("lon0") + F.col("lon1")) / 2, (F.col("lat0") + F.col("lat1")) / 2
    wide = KM_PER_DEGREE * F.cos(F.radians(lat))
    sides = F.greatest((F.col("lon1") - F.col("lon0")) * wide, (F.col("lat1") - F.col("lat0")) * KM_PER_DEGREE)
    b = F.least(F.lit(8.0), F.greatest(F.lit(3.0), 0.15 * sides))
    half = side_km / 2
    low = lambda c, mid, km: F.greatest(F.col(c) - b / km, mid - half / km).alias(c)
    high = lambda c, mid, km: F.least(F.col(c) + b / km, mid + half / km).alias(c)
    k = F.lit(KM_PER_DEGREE)
    return boundaries.select(key, utm_epsg(lon, lat).alias("epsg"), b.alias("buffer_km"), low("lon0", lon, wide), low("lat0", lat, k), high("lon1", lon, wide), high("lat1", lat, k))


def grid_cells(areas: DataFrame, key: str, res: float) -> DataFrame:
    """(key, cell_id, row, col, x, y, lon, lat): the cells of areas(key, epsg, lon0, lat0, lon1, lat1) in their zones' metres.

    A frame is the envelope of the four projected corners, snapped outward to whole multiples of res; rows count from the north. Rows
    are made first and then their cells, so that a large frame is made by many tasks.
    """
    zone, south = F.col("epsg") % 100, F.col("epsg") >= 32700
    corners = [utm(F.col(a), F.col(b), zone, south) for a in ("lon0", "lon1") for b in ("lat0", "lat1")]
    x, y = [c[0] for c in corners], [c[1] for c in corners]
    boxes = areas.select(key, "epsg", F.least(*x).alias("minx"), F.least(*y).alias("miny"), F.greatest(*x).alias("maxx"), F.greatest(*y).alias("maxy"))
    rows = snapped(boxes, res).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row"))
    cells = rows.repartition(key, "row").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("col"))
    at = cells.select(key, (F.col("row") * F.col("width") + F.col("col")).alias("cell_id"), "row", "col", "epsg", (F.col("minx") + (F.col("col") + 0.5) * res).alias("x"), (F.col("maxy") - (F.col("row") + 0.5) * res).alias("y"))
    lon, lat = utm_back(F.col("x"), F.col("y"), zone, south)
    return at.select(key, "cell_id", "row", "col", "x", "y", lon.alias("lon"), lat.alias("lat"))
