"""Evidence from images: numpy over Arrow batches for pixels, columns for the rest.

Images are rows (image_id, height, width, data): three bytes a pixel in the
order blue, green, red, row by row, as Spark's image source gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docverify.functions import lookups as L
from docverify.functions.bind import let

TILE = 24
QUALITY = 90
LONGEST = 900
#: Decimals that count before a value is rounded, so that no order of summation decides.
EXACT = 6

# The JPEG standard's example quantisation tables, luminance then chrominance, row by row.
JPEG_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
JPEG_CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]


def gray(bgr: np.ndarray) -> np.ndarray:
    """Rec. 601 luma."""
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    return 0.299 * r + 0.587 * g + 0.114 * b


def quality(g: np.ndarray) -> dict[str, float]:
    """I2's measurements: variance of the Laplacian inside, darkest over brightest quadrant."""
    h, w = g.shape
    if h > 2 and w > 2:
        lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
        blur = float((lap * lap).mean() - lap.mean() ** 2)
    else:
        blur = 0.0
    y, x = h // 2, w // 2
    means = [float(q.mean()) for q in (g[:y, :x], g[:y, x:], g[y:, :x], g[y:, x:]) if q.size]
    top = max(means, default=0.0)
    return {"lap_variance": blur, "illumination": min(means) / top if top > 0 else 1.0}


def noise_ratio(g: np.ndarray) -> float:
    """I7's measurement: largest over smallest variance in 3 x 3 zones; 1 where one is flat."""
    h, w = g.shape[0] // 3, g.shape[1] // 3
    if not h or not w:
        return 1.0
    zones = [g[y * h : (y + 1) * h, x * w : (x + 1) * w] for y in range(3) for x in range(3)]
    v = [float((z * z).mean() - z.mean() ** 2) for z in zones]
    return max(v) / min(v) if min(v) > 0 else 1.0


def qr_presence(g: np.ndarray) -> tuple[bool, float]:
    """I8: whether the right-hand box has dark and light in balance, and with what confidence; every fourth pixel counts."""
    h, w = g.shape
    x, y, bw, bh = int(w * 0.65), int(h * 0.15), int(w * 0.32), int(h * 0.55)
    box = g[y : y + bh, x : x + bw].ravel()[::4]
    dark, light = int((box < 60).sum()), int((box > 190).sum())
    share = dark / ((dark + light) or 1)
    there = 0.25 < share < 0.75
    return there, 0.90 if there else 0.20


def luminance_histogram(g: np.ndarray) -> list[int]:
    """16 bins over every fourth pixel."""
    bins = np.minimum(15, np.floor(g.ravel()[::4] / 16).astype(int))
    return np.bincount(bins, minlength=16).tolist()


@lru_cache(maxsize=1)
def _jpeg() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.arange(8)
    dct = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    dct[0] /= np.sqrt(2)
    scale = 200 - 2 * QUALITY
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (JPEG_LUMA, JPEG_CHROMA)]
    # both directions at once: a block of 64 values in a row times a table of 64 x 64
    return np.kron(dct, dct).T.copy(), *tables


def jpeg_round_trip(bgr: np.ndarray) -> np.ndarray:
    """The image after baseline JPEG coding at QUALITY, colours not subsampled; not bit-equal to any browser's."""
    dct, luma, chroma = _jpeg()
    h, w = bgr.shape[:2]
    full = np.pad(bgr.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    b, g, r = (full[:, :, i] for i in range(3))
    planes = [
        0.299 * r + 0.587 * g + 0.114 * b - 128,
        -0.168736 * r - 0.331264 * g + 0.5 * b,
        0.5 * r - 0.418688 * g - 0.081312 * b,
    ]
    out = []
    for plane, table in zip(planes, (luma, chroma, chroma), strict=True):
        blocks = plane.reshape(full.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        coded = np.rint(np.round(blocks.reshape(-1, 64) @ dct, EXACT) / table) * table
        out.append((coded @ dct.T).reshape(blocks.shape).transpose(0, 2, 1, 3).reshape(plane.shape))
    y, cb, cr = out[0] + 128, out[1], out[2]
    back = np.stack([y + 1.772 * cb, y - 0.344136 * cb - 0.714136 * cr, y + 1.402 * cr], axis=2)
    return np.clip(np.rint(np.round(back, EXACT)), 0, 255)[:h, :w].astype(np.uint8)


def fitted_size(height: int, width: int) -> tuple[int, int]:
    """Height and width within LONGEST pixels a side."""
    longest = max(height, width)
    if longest <= LONGEST:
        return height, width
    return tuple(max(1, (2 * n * LONGEST + longest) // (2 * longest)) for n in (height, width))


def _places(size: int, fitted_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each new pixel its two old ones, and the second's weight in parts of 2 * fitted_to."""
    at = np.maximum((2 * np.arange(fitted_to) + 1) * size - fitted_to, 0)
    low = at // (2 * fitted_to)
    return low, np.minimum(low + 1, size - 1), at % (2 * fitted_to)


def fitted(bgr: np.ndarray) -> np.ndarray:
    """The image within LONGEST pixels a side: bilinear, between the centres of pixels, in whole numbers, halves up."""
    h, w = bgr.shape[:2]
    nh, nw = fitted_size(h, w)
    if (nh, nw) == (h, w):
        return bgr
    (y0, y1, fy), (x0, x1, fx) = _places(h, nh), _places(w, nw)
    fy, fx = fy[:, None, None].astype(np.int32), fx[None, :, None].astype(np.int32)
    pixels = bgr.astype(np.int32)  # 255 x 4 x LONGEST x LONGEST is within 32 bits
    rows = pixels[y0] * (2 * nh - fy) + pixels[y1] * fy
    total = rows[:, x0] * (2 * nw - fx) + rows[:, x1] * fx
    return ((total + 2 * nh * nw) // (4 * nh * nw)).astype(np.uint8)


def error_level(bgr: np.ndarray) -> np.ndarray:
    """Mean absolute error of the three colours after a JPEG round trip, for each pixel."""
    off = np.abs(bgr.astype(np.int16) - jpeg_round_trip(bgr))
    return (off[:, :, 0] + off[:, :, 1] + off[:, :, 2]) / 3


def tile_means(values: np.ndarray) -> list[tuple[int, int, float]]:
    """I4: (tx, ty, mean) of whole tiles, row by row."""
    ty, tx = values.shape[0] // TILE, values.shape[1] // TILE
    means = values[: ty * TILE, : tx * TILE].reshape(ty, TILE, tx, TILE).mean(axis=(1, 3))
    return [(x, y, float(means[y, x])) for y in range(ty) for x in range(tx)]


def outlier_tiles(tiles: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """I5 on one image's tiles, in their order."""
    means = np.array([m for *_, m in tiles])
    if not len(means):
        return []
    limit = max(means.mean() + 2.3 * means.std(), 4.5)
    return [t for t in tiles if t[2] > limit]


def grouped_boxes(tiles: list[tuple[int, int, float]], width: int, height: int) -> list[dict]:
    """I6 on one image's outlier tiles; width and height are those of the image that was tiled.

    In reading order each tile not yet taken takes all others within two tiles
    of itself (not of those it takes); boxes are padded by six pixels and named
    by where they begin.
    """
    left, found = sorted(tiles, key=lambda t: (t[1], t[0])), []
    while left:
        sx, sy, _ = left[0]
        near = [abs(x - sx) <= 2 and abs(y - sy) <= 2 for x, y, _ in left]
        own = [t for t, n in zip(left, near, strict=True) if n]
        left = [t for t, n in zip(left, near, strict=True) if not n]
        xs, ys = [t[0] for t in own], [t[1] for t in own]
        x, y = max(0, min(xs) * TILE - 6), max(0, min(ys) * TILE - 6)
        w = min(width - x, (max(xs) - min(xs) + 1) * TILE + 12)
        h = min(height - y, (max(ys) - min(ys) + 1) * TILE + 12)
        if x / width < 0.40 and y / height < 0.70 and h > 40:
            region = "PORTRAIT"
        elif 0.40 < y / height < 0.75:
            region = "DETAILS"
        else:
            region = "ID_NUMBER" if y / height >= 0.75 else "TEXT"
        found.append({"x": x, "y": y, "w": w, "h": h, "max_error": max(t[2] for t in own), "region": region})
    return found


_MEASURED = (
    "image_id long, width int, height int, mean_gray double, lap_variance double, illumination double, noise_ratio double, "
    "has_qr boolean, qr_confidence double, hist array<int>, ela_mean double, ela_max double, fit_width int, fit_height int, "
    "tiles array<struct<tx:int,ty:int,mean:double>>, boxes array<struct<x:int,y:int,w:int,h:int,max_error:double,region:string>>"
)


def measure(images: DataFrame) -> DataFrame:
    """I1-I4, I6-I9 in one pass over pixels, which go no further.

    fit_width and fit_height are the size within LONGEST, which error levels,
    tiles and boxes refer to. Rows whose bytes aren't height x width x 3 (null
    and empty ones too) give no row: they have no evidence.
    """
    tile = pa.list_(pa.struct([("tx", pa.int32()), ("ty", pa.int32()), ("mean", pa.float64())]))
    box = pa.list_(pa.struct([(n, pa.int32()) for n in "xywh"] + [("max_error", pa.float64()), ("region", pa.string())]))
    schema = pa.schema(
        [("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("mean_gray", pa.float64())]
        + [(n, pa.float64()) for n in ("lap_variance", "illumination", "noise_ratio")]
        + [("has_qr", pa.bool_()), ("qr_confidence", pa.float64()), ("hist", pa.list_(pa.int32()))]
        + [("ela_mean", pa.float64()), ("ela_max", pa.float64()), ("fit_width", pa.int32()), ("fit_height", pa.int32())]
        + [("tiles", tile), ("boxes", box)]
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one image's pixels at a time
                image_id, h, w, data = (c[i].as_py() for c in batch.columns)
                if not data or not h or not w or len(data) != h * w * 3:
                    continue
                bgr = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                g, error = gray(bgr), error_level(fitted(bgr))
                there, confidence = qr_presence(g)
                tiles, (fh, fw) = tile_means(error), error.shape
                row = {
                    "image_id": image_id, "width": w, "height": h, "mean_gray": float(g.mean()), **quality(g),
                    "noise_ratio": noise_ratio(g), "has_qr": there, "qr_confidence": confidence, "hist": luminance_histogram(g),
                    "ela_mean": float(error.mean()), "ela_max": float(error.max()), "fit_width": fw, "fit_height": fh,
                    "tiles": [{"tx": x, "ty": y, "mean": m} for x, y, m in tiles], "boxes": grouped_boxes(outlier_tiles(tiles), fw, fh),
                }
                rows.append(row)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return images.select(F.col("image_id").cast("long"), "height", "width", "data").mapInArrow(measured, _MEASURED)


def histograms(images: DataFrame) -> DataFrame:
    """I9 alone: (image_id, hist) as measure gives them, without its other measurements."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i in range(batch.num_rows):
                image_id, h, w, data = (c[i].as_py() for c in batch.columns)
                if data and h and w and len(data) == h * w * 3:
                    ids.append(image_id)
                    found.append(luminance_histogram(gray(np.frombuffer(data, np.uint8).reshape(h, w, 3))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["image_id", "hist"])

    return images.select(F.col("image_id").cast("long"), "height", "width", "data").mapInArrow(counted, "image_id long, hist array<int>")


def quality_verdict(width: Column, height: Column, lap_variance: Column, illumination: Column) -> Column:
    """struct(blur_score, is_blurry, is_low_res, is_uneven, illumination, quality_score, quality_pass)."""
    low, blurry, uneven = (width < 400) | (height < 250), lap_variance < 65, illumination < 0.45
    score = (
        100
        - F.when(low, 35).otherwise(0)
        - F.when(blurry, F.least(F.lit(45.0), (65 - lap_variance) * 1.2)).otherwise(0)
        - F.when(uneven, 20).otherwise(0)
    )
    return F.struct(
        F.floor(lap_variance + 0.5).alias("blur_score"), blurry.alias("is_blurry"), low.alias("is_low_res"),
        uneven.alias("is_uneven"), F.round(illumination, 2).alias("illumination"),
        F.greatest(F.lit(10), F.floor(score + 0.5)).alias("quality_score"), (~low & ~blurry & ~uneven).alias("quality_pass"),
    )


def noise_verdict(ratio: Column) -> Column:
    """struct(ratio, edge, mismatch)."""
    edge = F.when(ratio > 4.5, F.least(F.lit(0.85), (ratio - 3) * 0.15)).otherwise(0.0)
    return F.struct(F.round(ratio, 2).alias("ratio"), F.round(edge, 2).alias("edge"), (ratio > 4.0).alias("mismatch"))


def tile_table(measured: DataFrame) -> DataFrame:
    """I4: a row for each tile of the error levels."""
    return measured.select("image_id", "width", "height", F.explode("tiles").alias("t")).select("image_id", "width", "height", "t.*")


def tile_outliers(tiles: DataFrame) -> DataFrame:
    """I5, each tile: tiles with mu, sigma (population) over the image's tiles, and is_outlier."""
    w = Window.partitionBy("image_id")
    return (
        tiles.withColumn("mu", F.avg("mean").over(w))
        .withColumn("sigma", F.stddev_pop("mean").over(w))
        .withColumn("is_outlier", (F.col("mean") > F.col("mu") + 2.3 * F.col("sigma")) & (F.col("mean") > 4.5))
    )


def tile_summary(tiles: Column) -> Column:
    """I5 in the image's own row, without a shuffle: struct(mu, sigma, n_outliers, uniform, localized); null without tiles."""

    def summed(m: Column) -> Column:
        n = F.size(m)
        mu = F.aggregate(m, F.lit(0.0), lambda s, x: s + x) / n
        return let(F.struct(m.alias("m"), n.alias("n"), mu.alias("mu")), spread)

    def spread(t: Column) -> Column:
        squares = F.aggregate(t["m"], F.lit(0.0), lambda s, x: s + (x - t["mu"]) * (x - t["mu"]))
        return let(F.struct(t["m"].alias("m"), t["mu"].alias("mu"), F.sqrt(squares / t["n"]).alias("sigma")), judged)

    def judged(t: Column) -> Column:
        outliers = F.size(F.filter(t["m"], lambda x: (x > t["mu"] + 2.3 * t["sigma"]) & (x > 4.5)))
        uniform = (t["mu"] > 6.0) & (t["sigma"] < 2.5)
        return F.struct(
            t["mu"].alias("mu"), t["sigma"].alias("sigma"), outliers.alias("n_outliers"), uniform.alias("uniform"),
            ((outliers >= 2) & ~uniform).alias("localized"),
        )

    return F.when(F.size(tiles) > 0, let(F.transform(tiles, lambda t: t["mean"]), summed))


def tile_verdicts(outliers: DataFrame) -> DataFrame:
    """I5, each image: n_outliers, uniform and localized."""
    uniform = (F.col("mu") > 6.0) & (F.col("sigma") < 2.5)
    return (
        outliers.groupBy("image_id")
        .agg(F.max("mu").alias("mu"), F.max("sigma").alias("sigma"), F.count_if("is_outlier").alias("n_outliers"))
        .withColumn("uniform", uniform)
        .withColumn("localized", (F.col("n_outliers") >= 2) & ~F.col("uniform"))
    )


def outlier_boxes(measured: DataFrame) -> DataFrame:
    """(image_id, box, x, y, w, h, max_error, region): the boxes that measure found, a row each, without a shuffle."""
    each = measured.select("image_id", F.posexplode("boxes").alias("box", "b")).select("image_id", "box", "b.*")
    return each.withColumn("max_error", F.round("max_error", 2))


def forensic_risk(localized: Column, uniform: Column, mismatch: Column, edge: Column, quality_pass: Column) -> Column:
    """struct(risk_score, risk, confidence)."""
    score = F.least(
        F.lit(0.98),
        F.greatest(
            F.lit(0.02),
            0.05
            + F.when(localized, 0.55).when(uniform, 0.15).otherwise(0.0)
            + F.when(mismatch, 0.25).otherwise(0.0)
            + F.when(edge > 0.4, 0.20).otherwise(0.0),
        ),
    )
    exact = F.round(score, 2)
    return F.struct(
        exact.alias("risk_score"), F.when(exact >= 0.65, "HIGH").when(exact >= 0.35, "MEDIUM").otherwise("LOW").alias("risk"),
        F.when(quality_pass, 0.90).otherwise(0.45).alias("confidence"),
    )


def _region_risk(max_error: Column) -> Column:
    return F.round(F.least(F.lit(0.95), max_error / 20 + 0.4), 3)


def flagged_regions(boxes: DataFrame) -> DataFrame:
    """I10's regions: outlier boxes with the risk of each."""
    return boxes.withColumn("risk", _region_risk(F.col("max_error")))


def regions(boxes: Column, localized: Column) -> Column:
    """I10's regions in the image's own row: array of struct(region, bbox, risk, reason), empty unless errors are localized."""

    def region(b: Column) -> Column:
        return let(
            F.round(b["max_error"], 2),
            lambda m: F.struct(
                b["region"].alias("region"), F.array(b["x"], b["y"], b["w"], b["h"]).alias("bbox"), _region_risk(m).alias("risk"),
                F.concat(F.lit("ELA "), F.format_number(m, 2), F.lit(" in "), b["region"]).alias("reason"),
            ),
        )

    return F.when(F.coalesce(localized, F.lit(False)), F.transform(boxes, region)).otherwise(F.filter(F.transform(boxes, region), lambda r: F.lit(False)))


def check_layout(df: DataFrame) -> DataFrame:
    """Df with aspect, layout_score, layout_pass and anomalies.

    Reads doc_type, width, height, photo_x, photo_y and mrz_y (null where not
    detected). Types without a template are held to AADHAAR's. A width or
    height that is null or 0 is no evidence: what depends on it raises nothing,
    and the aspect ratio is null. The templates are three rows, so the join is
    a broadcast.
    """
    templates = df.sparkSession.createDataFrame(L.TEMPLATES, L.TEMPLATE_FIELDS).withColumnRenamed("doc_type", "__type")
    known = F.upper(F.coalesce("doc_type", F.lit("AADHAAR")))
    kind = F.when(known.isin([t[0] for t in L.TEMPLATES]), known).otherwise("AADHAAR")
    joined = df.withColumn("__kind", kind).join(F.broadcast(templates), F.col("__kind") == F.col("__type"))
    x, y, slack = F.try_divide("photo_x", "width"), F.try_divide("photo_y", "height"), 0.10
    aspect = F.nullif(F.try_divide("width", "height"), F.lit(0.0))
    off = F.abs(aspect - F.col("aspect")) > F.col("tolerance")
    moved = ~(x.between(F.col("x_min") - slack, F.col("x_max") + slack) & y.between(F.col("y_min") - slack, F.col("y_max") + slack))
    high = (known == "PASSPORT") & (F.try_divide("mrz_y", "height") < 0.70)
    on = lambda c: F.coalesce(c, F.lit(False))
    score = 100 - F.when(on(off), 20).otherwise(0) - F.when(on(moved), 25).otherwise(0) - F.when(on(high), 30).otherwise(0)
    anomalies = F.array_compact(
        F.array(F.when(on(off), "ASPECT_RATIO_DEVIATION"), F.when(on(moved), "PHOTO_DISPLACED"), F.when(on(high), "MRZ_DISPLACED"))
    )
    return (
        joined.withColumn("layout_score", F.greatest(F.lit(10), score))
        .withColumn("layout_pass", F.col("layout_score") >= 70)
        .withColumn("anomalies", anomalies)
        .withColumn("aspect_ratio", F.round(aspect, 2))
        .drop("__kind", "__type", "aspect", "tolerance", "x_min", "y_min", "x_max", "y_max")
    )
