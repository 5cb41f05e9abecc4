"""Layer arithmetic: scaling and harmonisation, units, masks, outcome classes, epochs in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, nan0, normalised_difference
from .order import percentiles

# Bands, slope and intercept that put TM reflectance on the OLI scale, and the sensors' scale and offset.
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
SLOPE = (0.8474, 0.8483, 0.9047, 0.8462, 0.8937, 0.9071)
INTERCEPT = (0.0003, 0.0088, 0.0061, 0.0412, 0.0254, 0.0172)
REFLECTANCE = (0.0000275, -0.2)
KELVIN = (0.00341802, 149.0, 273.15)
CLEAR_BITS = {"qa_pixel": (1, 2, 3, 4), "qa60": (10, 11)}


def reflectance(dn: Column, band: str | None = None) -> Column:
    """Digital number to reflectance; with a band, of the older sensor, harmonised."""
    r = dn * REFLECTANCE[0] + REFLECTANCE[1]
    if band is None:
        return r
    i = BANDS.index(band)
    return r * SLOPE[i] + INTERCEPT[i]


def celsius(dn: Column) -> Column:
    return dn * KELVIN[0] + KELVIN[1] - KELVIN[2]


def clear(quality: Column, kind: str) -> Column:
    """None of the kind's cloud bits is set."""
    return quality.bitwiseAND(sum(1 << b for b in CLEAR_BITS[kind])) == 0


def indices(red: Column, green: Column, blue: Column, nir: Column, swir: Column) -> dict[str, Column]:
    return {
        "ndvi": normalised_difference(nir, red), "ndbi": normalised_difference(swir, nir), "ndwi": normalised_difference(green, nir),
        "brightness": (red + green + blue) / 3,
    }


def rural(built: Column, water: Column, excluded: Column, most: float = 0.02) -> Column:
    return (built < most) & ~F.coalesce(water, F.lit(False)) & ~F.coalesce(excluded, F.lit(False))


def outcome(urban: Column, predicted: Column, observed: Column) -> Column:
    """0 neither, 1 urban before, 2 hit, 3 miss, 4 false alarm; later ones take precedence."""
    return F.when(predicted & ~observed, 4).when(~predicted & observed, 3).when(predicted & observed, 2).when(urban, 1).otherwise(0)


def setting(built: Column, urban: float = 0.2, rural_: float = 0.02) -> Column:
    return F.when(built >= urban, "urban").when(built >= rural_, "peri-urban").otherwise("rural")


def between(a: Column, b: Column, year: Column, y0: int, y1: int) -> Column:
    """The value of a year between two epochs."""
    w = (year - y0) / float(y1 - y0)
    return a * (1 - w) + b * w


def cooling_potential(cells: DataFrame, intensity: str, ndvi: Column, built: Column) -> DataFrame:
    """Adds potential: heat over its 95th percentile, times bare ground, times built fraction."""
    heat = F.greatest(nan0(F.col(intensity)), F.lit(0.0))
    top = percentiles(cells, heat, [0.95]).select(F.greatest(F.col("q")[0], F.lit(1e-6)).alias("top"))
    bare = 1 - clip(nan0(ndvi) / 0.3, 0, 1)
    return cells.join(F.broadcast(top)).withColumn("potential", clip(heat / F.col("top") * bare * clip(nan0(built), 0, 1), 0, 1)).drop("top")


def composite_depth(scenes: DataFrame, keys: list[str], taken: str, least: int) -> DataFrame:
    """(keys, scenes, days, enough): distinct days of acquisition against the least number."""
    g = scenes.groupBy(*keys).agg(F.count("*").alias("scenes"), F.countDistinct(F.to_date(taken)).alias("days"))
    return g.withColumn("enough", F.col("days") >= least)


def required_depth(scenes: DataFrame, keys: list[str], taken: str, least: int) -> DataFrame:
    """composite_depth; an error if any composite is too thin."""
    g = composite_depth(scenes, keys, taken, least)
    thin = g.where("NOT enough").limit(5).collect()
    if thin:
        raise ValueError(f"composites of fewer than {least} days: {[tuple(r) for r in thin]}")
    return g


def transitions(labels: DataFrame, images: DataFrame, step: int) -> DataFrame:
    """(year, until) of label years `step` apart that both have images."""
    a, b = labels.select("year").distinct(), labels.select(F.col("year").alias("until")).distinct()
    pairs = a.join(b, F.col("until") == F.col("year") + step)
    seen = images.select("year").distinct()
    return pairs.join(seen, "year", "left_semi").join(seen.withColumnRenamed("year", "until"), "until", "left_semi").select("year", "until")


def shared_columns(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames cut to the columns that all have, in the first one's order."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return [f.select(*names) for f in frames]


def stacked(frames: dict[str, DataFrame], name: str = "part") -> DataFrame:
    """Union by name of what all have, with the frame's key."""
    cut = shared_columns(list(frames.values()))
    out = None
    for key, f in zip(frames, cut):
        f = f.withColumn(name, F.lit(key))
        out = f if out is None else out.unionByName(f)
    return out


def channel_stack(scenes: DataFrame, now: Column, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """(row, col, <channel>_t, <channel>_prev, <channel>_change): the mean scene of a cell now and before, their indices, and the differences; null where a date is missing.

    scenes(row, col, bands): one pivot by conditional means, so each scene is read once.
    """
    then = ~now
    mean = lambda b, when: F.avg(F.when(when, F.col(b)))
    wide = scenes.groupBy("row", "col").agg(*[mean(b, now).alias(f"{b}_t") for b in bands], *[mean(b, then).alias(f"{b}_prev") for b in bands])
    out = {}
    for end in ("t", "prev"):
        c = {b: F.col(f"{b}_{end}") for b in bands}
        out |= {f"{b}_{end}": x for b, x in c.items()}
        out |= {f"ndvi_{end}": normalised_difference(c["nir"], c["red"]), f"ndbi_{end}": normalised_difference(c["swir1"], c["nir"]), f"ndwi_{end}": normalised_difference(c["green"], c["nir"])}
        out[f"brightness_{end}"] = sum((c[b] for b in bands[1:]), c[bands[0]]) / len(bands)
    names = [*bands, "ndvi", "ndbi", "ndwi", "brightness"]
    change = [(out[f"{n}_t"] - out[f"{n}_prev"]).alias(f"{n}_change") for n in names]
    return wide.select("row", "col", *[out[f"{n}_{end}"].alias(f"{n}_{end}") for end in ("t", "prev") for n in names], *change)
