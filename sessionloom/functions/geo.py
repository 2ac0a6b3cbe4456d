"""Geographic expressions built from native columns only."""

from pyspark.sql import Column, DataFrame, functions as F

# The geohash base-32 alphabet and the WGS-84 ellipsoid.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
WGS84_RADIUS_KM = 6378.137
WGS84_FLATTENING = 1 / 298.257223563


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the half-open cell (lower edge excluded) among 2**bits equal cells."""
    steps = float(2**bits)
    index = F.ceil((value - F.lit(low)) / F.lit(span) * F.lit(steps)) - 1
    return F.greatest(F.least(index, F.lit(2**bits - 1)), F.lit(0)).cast("bigint")


def _letters(first_axis_bits: int) -> str:
    """The alphabet reordered so that a letter is found by (first axis bits, other axis bits).

    A letter holds five interleaved bits: first axis, other, first, other, first.
    """
    other_bits = 5 - first_axis_bits
    table = ""
    for cell in range(32):
        first, other = cell >> other_bits, cell & ((1 << other_bits) - 1)
        digit = 0
        for place in range(5):
            bits, width = (first, first_axis_bits) if place % 2 == 0 else (other, other_bits)
            digit = digit * 2 + (bits >> (width - 1 - place // 2) & 1)
        table += GEOHASH_ALPHABET[digit]
    return table


def geohash_cells(lat: Column, lon: Column, precision: int = 7) -> tuple[Column, Column]:
    """Cell numbers of the coordinates on the (longitude, latitude) grid of a precision."""
    total = 5 * precision
    x = _cell(lon, -180.0, 360.0, (total + 1) // 2)
    y = _cell(lat, -90.0, 180.0, total // 2)
    # least() and greatest() skip NULLs, so a missing coordinate is ruled out here.
    known = lat.isNotNull() & lon.isNotNull()
    return F.when(known, x), F.when(known, y)


def geohash_from_cells(x: Column, y: Column, precision: int = 7) -> Column:
    """Geohash string of grid cells; letters take turns in starting with longitude."""
    table = F.lit(_letters(3))
    x_left, y_left = (5 * precision + 1) // 2, 5 * precision // 2
    letters = []
    for place in range(precision):
        x_bits, y_bits = (3, 2) if place % 2 == 0 else (2, 3)
        x_left, y_left = x_left - x_bits, y_left - y_bits
        u = F.shiftright(x, x_left).bitwiseAND(F.lit((1 << x_bits) - 1))
        v = F.shiftright(y, y_left).bitwiseAND(F.lit((1 << y_bits) - 1))
        index = u * 4 + v if x_bits == 3 else v * 4 + u
        letters.append(F.substring(table, (index + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def with_geohash(
    df: DataFrame, name: str, lat: Column, lon: Column, precision: int = 7
) -> DataFrame:
    """Add the geohash of two coordinates; NULL when one is missing.

    Each axis is quantised once, in its own projection, and a letter reads its bits from
    both cell numbers. A value exactly on a cell edge belongs to the lower cell.
    """
    x, y = geohash_cells(lat, lon, precision)
    code = geohash_from_cells(F.col("_x"), F.col("_y"), precision)
    return df.withColumns({"_x": x, "_y": y}).withColumn(name, code).drop("_x", "_y")


def reduced_latitude(lat: Column) -> Column:
    return F.atan(F.lit(1 - WGS84_FLATTENING) * F.tan(F.radians(lat)))


def _central_angle(b1: Column, b2: Column, turn: Column) -> Column:
    hav = F.pow(F.sin((b2 - b1) / 2), 2.0) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(turn), 2.0)
    # least() skips NULLs, so the angle is only taken where it is known.
    return F.when(hav.isNotNull(), F.asin(F.sqrt(F.least(hav, F.lit(1.0)))) * 2)


def _lambert_km(b1: Column, b2: Column, sigma: Column) -> Column:
    mid, half = (b1 + b2) / 2, (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.try_divide(
        F.pow(F.sin(mid) * F.cos(half), 2.0), F.pow(F.cos(sigma / 2), 2.0)
    )
    y = (sigma + F.sin(sigma)) * F.try_divide(
        F.pow(F.cos(mid) * F.sin(half), 2.0), F.pow(F.sin(sigma / 2), 2.0)
    )
    return F.when(sigma == 0, F.lit(0.0)).otherwise(
        F.lit(WGS84_RADIUS_KM) * (sigma - F.lit(WGS84_FLATTENING / 2) * (x + y))
    )


def with_geodesic_km(
    df: DataFrame, name: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column
) -> DataFrame:
    """Add the distance on the WGS-84 ellipsoid by Lambert's long-line formula; NULL-safe.

    Relative error stays near 1e-6, against up to 5.6e-3 for a sphere. Reduced latitudes
    and the central angle are projected first, so each is computed once per row.
    """
    b1, b2 = F.col("_b1"), F.col("_b2")
    return (
        df.withColumns(
            {"_b1": reduced_latitude(lat1), "_b2": reduced_latitude(lat2), "_turn": F.radians(lon2 - lon1) / 2}
        )
        .withColumn("_sigma", _central_angle(b1, b2, F.col("_turn")))
        .withColumn(name, _lambert_km(b1, b2, F.col("_sigma")))
        .drop("_b1", "_b2", "_turn", "_sigma")
    )


def geodesic_km_each(points: Column, reduced: Column, lon: Column) -> Column:
    """`with_geodesic_km` of one place, by its `reduced_latitude`, to each of an array of points
    that have ``reduced`` and ``lon``; as an array in the same order."""
    angles = F.transform(
        points, lambda p: F.struct(
            p["reduced"].alias("b"), _central_angle(p["reduced"], reduced, F.radians(lon - p["lon"]) / 2).alias("sigma")
        )
    )
    return F.transform(angles, lambda p: _lambert_km(p["b"], reduced, p["sigma"]))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance in degrees."""
    return F.sqrt(F.pow(lat1 - lat2, 2.0) + F.pow(lon1 - lon2, 2.0))
