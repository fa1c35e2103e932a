"""Geography: distances on a sphere, boxes, geohash and Hilbert cells, as columns of degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: mean radius of the earth in metres.
RADIUS = 6371008.8
#: Fixed value: the alphabet of geohash.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirectangular(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    x = F.radians(lng2 - lng1) * F.cos(F.radians(lat1 + lat2) / 2)
    return RADIUS * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    dlng = F.radians(lng2 - lng1)
    y = F.sin(dlng) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlng)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def destination(lat: Column, lng: Column, metres: Column, degrees: Column) -> tuple[Column, Column]:
    d, b, p = metres / RADIUS, F.radians(degrees), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    r = F.radians(lng) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), (F.degrees(r) + 540) % 360 - 180


def box(lat: float, lng: float, metres: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) of a circle; west is greater than east where it spans the date line."""
    import math

    d = math.degrees(metres / RADIUS)
    south, north = max(-90.0, lat - d), min(90.0, lat + d)
    if south == -90.0 or north == 90.0:
        return south, north, -180.0, 180.0
    w = math.degrees(math.asin(min(1.0, math.sin(metres / RADIUS) / math.cos(math.radians(lat)))))
    west, east = lng - w, lng + w
    return south, north, west + 360 if west < -180 else west, east - 360 if east > 180 else east


def in_box(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    """Plain comparisons, so that the scan can skip row groups."""
    across = (lng >= west) & (lng <= east) if west <= east else (lng >= west) | (lng <= east)
    return (lat >= south) & (lat <= north) & across


def near(df: DataFrame, lat: float, lng: float, most: float, least: float = 0.0, limit: int = 100, lat_col: str = "lat", lng_col: str = "lng", key: str = "id") -> DataFrame:
    """Rows within [least, most] metres, nearest first: a box on plain columns first, then the distance."""
    inside = df.where(in_box(F.col(lat_col), F.col(lng_col), *box(lat, lng, most)))
    d = haversine(F.lit(lat), F.lit(lng), F.col(lat_col), F.col(lng_col))
    out = inside.withColumn("distance", d).where((F.col("distance") <= most) & (F.col("distance") >= least))
    return out.orderBy("distance", key).limit(limit)


def cell(lat: Column, lng: Column, bits: int) -> Column:
    """The number whose bits are, by turns, those of the longitude and the latitude, from the top."""
    n_lng, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lng + 180) / 360 * (1 << n_lng)), F.lit((1 << n_lng) - 1))
    y = F.least(F.floor((lat + 90) / 180 * (1 << n_lat)), F.lit((1 << n_lat) - 1))
    out = F.lit(0).cast("long")
    for i in range(bits):
        source, at = (x, n_lng - 1 - i // 2) if i % 2 == 0 else (y, n_lat - 1 - i // 2)
        out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(source.cast("long"), at).bitwiseAND(F.lit(1).cast("long")))
    return out


def geohash(lat: Column, lng: Column, length: int = 6) -> Column:
    number = cell(lat, lng, 5 * length)
    letters = [F.substring(F.lit(BASE32), (F.shiftright(number, 5 * (length - 1 - i)).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for i in range(length)]
    return F.concat(*letters)


def geohash_centre(code: Column, length: int = 6) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a cell."""
    x = y = F.lit(0).cast("long")
    for i in range(5 * length):
        value = F.position(F.substring(code, i // 5 + 1, 1), F.lit(BASE32)) - 1
        bit = F.shiftright(value.cast("long"), 4 - i % 5).bitwiseAND(F.lit(1).cast("long"))
        if i % 2 == 0:
            x = F.shiftleft(x, 1).bitwiseOR(bit)
        else:
            y = F.shiftleft(y, 1).bitwiseOR(bit)
    n_lng, n_lat = (5 * length + 1) // 2, 5 * length // 2
    return (y + 0.5) / (1 << n_lat) * 180 - 90, (x + 0.5) / (1 << n_lng) * 360 - 180


def hilbert(lat: Column, lng: Column, order: int = 8) -> Column:
    """Place of the cell on a Hilbert curve over 2^order by 2^order cells: near rows have near numbers, so files sorted
    by it can be skipped by area."""
    side = 1 << order
    x = F.least(F.floor((lng + 180) / 360 * side), F.lit(side - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * side), F.lit(side - 1)).cast("long")
    steps = F.transform(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("long"))

    def step(state: Column, s: Column) -> Column:
        rx = F.when(state["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(state["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = state["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        fx, fy = F.when((ry == 0) & (rx == 1), side - 1 - state["x"]).otherwise(state["x"]), F.when((ry == 0) & (rx == 1), side - 1 - state["y"]).otherwise(state["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).cast("long").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("long").alias("y"), d.cast("long").alias("d"))

    return F.aggregate(steps, F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d")), step)["d"]
