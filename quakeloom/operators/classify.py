"""Classification against gridded models and named points; rasters and cubes as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import nearest_named, small


def domain(lon: Column, breaks: tuple[tuple[float, str], ...], east: str) -> Column:
    """The name of the first break that the longitude lies below; ``east`` beyond the last."""
    out = F.lit(east)
    for b, name in reversed(breaks):
        out = F.when(lon < b, name).otherwise(out)
    return out


def is_obs(net: Column, networks: tuple[str, ...] = ("7D", "X9", "Z5", "OO")) -> Column:
    return net.isin(*networks)


def grid_bilinear(points: DataFrame, grid: DataFrame, step: float, name: str, key: str = "id") -> DataFrame:
    """``points`` with the grid's value at (lon, lat) by bilinear interpolation; null where a corner is missing or null.

    The grid (lon, lat, v) is a lattice of spacing ``step``. The four corners are equality joins on whole cells.
    """
    cell = grid.where("v is not null").select(F.round(F.col("lon") / step).cast("long").alias("gx"), F.round(F.col("lat") / step).cast("long").alias("gy"), "v")
    x, y = F.col("lon") / step, F.col("lat") / step
    p = points.select(key, F.floor(x).alias("x0"), F.floor(y).alias("y0"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    c = p.withColumn("c", corner).withColumn("w", F.when(F.col("c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))).where("w > 0")
    c = c.withColumn("gx", F.col("x0") + F.col("c.i")).withColumn("gy", F.col("y0") + F.col("c.j")).join(small(cell), ["gx", "gy"], "left")
    value = c.groupBy(key).agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("v"))).alias(name))
    return points.join(value, key, "left")


def model_trilinear(points: DataFrame, cube: DataFrame, steps: tuple[float, float, float], name: str, key: str = "id") -> DataFrame:
    """The same in three dimensions (depth, lat, lon, v); null outside."""
    axes = ("depth", "lat", "lon")
    cell = cube.where("v is not null").select(*[F.round(F.col(a) / s).cast("long").alias(f"g_{a}") for a, s in zip(axes, steps, strict=True)], "v")
    p = points.select(key, *[(F.col(a) / s).alias(a) for a, s in zip(axes, steps, strict=True)])
    bits = F.explode(F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(j).alias("lat"), F.lit(k).alias("lon")) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    c = p.withColumn("c", bits)
    weight = F.lit(1.0)
    for a in axes:
        f = F.col(a) - F.floor(a)
        weight = weight * F.when(F.col(f"c.{a}") == 1, f).otherwise(1 - f)
        c = c.withColumn(f"g_{a}", F.floor(a) + F.col(f"c.{a}"))
    c = c.withColumn("w", weight).where("w > 0").join(small(cell), [f"g_{a}" for a in axes], "left")
    value = c.groupBy(key).agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("v"))).alias(name))
    return points.join(value, key, "left")


def raster_lookup(points: DataFrame, raster: DataFrame, step: float, name: str, key: str = "id") -> DataFrame:
    """The value of the cell whose lower corner is at or below the point; points outside take the edge's cell."""
    ends = raster.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)])
    cell = raster.select(F.round(F.col("lon") / step).cast("long").alias("gx"), F.round(F.col("lat") / step).cast("long").alias("gy"), F.col("v").alias(name))
    inside = lambda c: F.floor(F.greatest(F.col(f"min_{c}"), F.least(F.col(c), F.col(f"max_{c}"))) / step + 1e-9)
    p = points.crossJoin(F.broadcast(ends)).withColumn("gx", inside("lon")).withColumn("gy", inside("lat"))
    return p.join(small(cell), ["gx", "gy"], "left").select(*points.columns, name)


def roughness(raster: DataFrame, half: int = 2) -> DataFrame:
    """``x, y, rough``: deviation of z over the square of cells around each; beyond an edge the edge's cell counts again. Cells are whole numbers."""
    ends = raster.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    around = F.sequence(F.lit(-half), F.lit(half))
    want = raster.select(F.col("x").alias("cx"), F.col("y").alias("cy")).crossJoin(F.broadcast(ends)).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    x, y = F.greatest("x0", F.least("x1", F.col("cx") + F.col("dx"))), F.greatest("y0", F.least("y1", F.col("cy") + F.col("dy")))
    near = want.select("cx", "cy", x.alias("x"), y.alias("y")).join(raster, ["x", "y"])
    return near.groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("z") * F.col("z")) - F.avg("z") * F.avg("z"))).alias("rough"))


def model_anomaly(cube: DataFrame) -> DataFrame:
    """Per cent from the mean of the depth."""
    mean = F.avg("v").over(Window.partitionBy("depth"))
    return cube.withColumn("anomaly", 100 * (F.col("v") - mean) / mean)


def swath(cube: DataFrame, south: float, north: float) -> DataFrame:
    return cube.where(F.col("lat").between(south, north)).groupBy("depth", "lon").agg(F.avg("v").alias("v"))


def sample_cells(raster: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n non-null cells, the same ones each time."""
    return raster.where("v is not null").orderBy(F.xxhash64("lon", "lat", F.lit(seed)), "lon", "lat").limit(n)


def classify(events: DataFrame, slab: DataFrame, unc: DataFrame, volcanoes: DataFrame, margin: float = 5.0, vol_radius: float = 20.0, step: float = 0.05) -> DataFrame:
    """``event_class`` by where an event lies: near a volcano (strictly within the radius), at the interface (within the grid's
    uncertainty and margin, ends included), above it in the crust, below it in the slab, or oceanic where slab or uncertainty is unknown.

    Adds slab_km (positive down), band_km, dz_km (event minus interface), name and name_km.
    """
    e = grid_bilinear(grid_bilinear(events, slab, step, "_slab"), unc, step, "_unc")
    e = e.withColumn("slab_km", F.abs("_slab")).withColumn("band_km", F.col("_unc") + margin).withColumn("dz_km", F.col("depth") - F.col("slab_km")).drop("_slab", "_unc")
    e = nearest_named(e, volcanoes, "flat_named")
    known = F.col("dz_km").isNotNull() & F.col("band_km").isNotNull()
    inside = F.when(F.abs("dz_km") <= F.col("band_km"), "megathrust?").when(F.col("dz_km") < 0, "crustal-fault").otherwise("intraslab")
    kind = F.when(F.col("name_km") < vol_radius, "volcanic").when(known, inside).otherwise("oceanic")
    return e.withColumn("event_class", kind)
