"""Plot dimensions, areas, boxes and map positions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and the length of a degree of latitude.
FOOT_M = 0.3048
SQM_SQFT = 10.7639
SQYD_SQM = 0.836127
DEGREE_M = 111000.0


# Words of a plot's sides, and signs between two sizes.
EAST_WEST = ("east", "ew", "e")
NORTH_SOUTH = ("north", "ns", "n")
BETWEEN = ("x", "×", ",")


def dimensions(c: Column) -> Column:
    """struct(ew, ns) in metres of "60 ft x 40 m" or "east-west 60ft,
    north-south 40ft"; feet where no unit is named, null where nothing fits.

    The text is read as numbers, words and signs. A size is a number and the
    word after it; two sizes belong together by the sides named before them,
    else by the sign between them."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+(?:\.[0-9]+)?|[a-z]+|[×,]"), F.lit(0))
    return _given(words, _sizes)


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sizes(tokens: Column) -> Column:
    """`dimensions` of the words of a text."""
    at = lambda i: F.get(tokens, i)
    number = lambda i: at(i).try_cast("double")
    unit = lambda i: F.coalesce(at(i + 1), F.lit("")).rlike("^[fm]")
    metres = lambda i: number(i) * F.when(F.coalesce(at(i + 1), F.lit("")).startswith("m"), 1.0).otherwise(FOOT_M)
    pair = lambda i, j: F.struct(metres(i).alias("ew"), metres(j).alias("ns"))
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    # named sides: the number after the first east word, and the one after the next north word
    side = lambda words, after: F.get(F.filter(places, lambda i: (i > after) & at(i).isin(*words)), F.lit(0))
    # a sign, after the first number or after its unit, and a number after that
    sign = lambda i: i + F.when(unit(i), 2).otherwise(1)

    def read(numbers: Column) -> Column:
        then = lambda place: F.get(F.filter(numbers, lambda i: i > place), F.lit(0))
        crossed = F.filter(numbers, lambda i: at(sign(i)).isin(*BETWEEN) & number(sign(i) + 1).isNotNull())
        across = _given(F.get(crossed, F.lit(0)), lambda i: F.when(i.isNotNull(), pair(i, sign(i) + 1)))
        beside = lambda first, second: F.when(second.isNotNull(), pair(first, second)).otherwise(across)
        north = lambda first: _given(side(NORTH_SOUTH, first), lambda n: _given(then(n), lambda second: beside(first, second)))
        return _given(side(EAST_WEST, F.lit(-1)), lambda east: _given(then(east), north))

    return _given(F.filter(places, lambda i: number(i).isNotNull()), read)


def area_sqm(size: Column) -> Column:
    return F.round(size["ew"] * size["ns"], 2)


def square_metres(yards: Column) -> Column:
    """Of square yards."""
    return yards * SQYD_SQM


def unscaled_box(box: dict[str, Column], scale: Column) -> dict[str, Column]:
    """A box found on a resized page, on the page itself; halves go to even."""
    return {name: F.bround(x / scale).cast("long") for name, x in box.items()}


def feature_point(kind: Column, point: Column, vertices: Column) -> Column:
    """struct(lng, lat): a Point's own place, else the mean of all vertices."""
    mean = lambda k: F.aggregate(vertices, F.lit(0.0), lambda n, v: n + v[k]) / F.size(vertices)
    return F.when(kind == "Point", F.struct(point[0].alias("lng"), point[1].alias("lat"))).when(
        F.size(vertices) > 0, F.struct(mean(0).alias("lng"), mean(1).alias("lat"))
    )


def ring_geometry(rings: Column) -> Column:
    """struct(type, polygons): one ring is a Polygon, several are a
    MultiPolygon of one ring each; null without any."""
    kind = F.when(F.size(rings) == 1, "Polygon").otherwise("MultiPolygon")
    return F.when(F.size(rings) > 0, F.struct(kind.alias("type"), F.transform(rings, lambda r: F.array(r)).alias("polygons")))


def rectangle(lat: Column, lng: Column, size: Column) -> Column:
    """Closed ring of (lng, lat) corners of a plot around its centre."""
    dx = size["ew"] / 2 / (F.cos(F.radians(lat)) * DEGREE_M)
    dy = size["ns"] / 2 / DEGREE_M
    corners = ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))
    return F.array(*[F.array(lng + dx * i, lat + dy * j) for i, j in corners])


def map_pixel(lat: Column, lng: Column, zoom: int) -> Column:
    """struct(x, y): Web Mercator pixel, 256 to a tile."""
    width = 256.0 * 2**zoom
    x = (lng / 360 + 0.5) * width
    y = (0.5 - F.asinh(F.tan(F.radians(lat))) / (2 * pi)) * width
    return F.struct(x.alias("x"), y.alias("y"))


def box_within(box: dict[str, Column], width: Column, height: Column, inclusive: bool = False) -> Column:
    """Whether a box lies on its page; `inclusive` lets it begin on the far edge."""
    far = (box["x_min"] <= width) & (box["y_min"] <= height) if inclusive else (box["x_min"] < width) & (box["y_min"] < height)
    near = (box["x_min"] >= 0) & (box["y_min"] >= 0)
    ends = (box["x_max"] <= width) & (box["y_max"] <= height)
    if not inclusive:
        ends = ends & (box["x_max"] > 0) & (box["y_max"] > 0)
    return near & far & ends & (box["x_min"] <= box["x_max"]) & (box["y_min"] <= box["y_max"])


def line_bands(top: Column, bottom: Column, band: int = 75) -> Column:
    """array(struct(top, bottom)): a region cut into bands of `band` pixels,
    whole if it is at most one and a half bands high."""
    starts = F.sequence(top, F.greatest(top, bottom - 1), F.lit(band).cast("long"))
    cut = F.transform(starts, lambda y: F.struct(y.alias("top"), F.least(y + band, bottom).alias("bottom")))
    whole = F.array(F.struct(top.alias("top"), bottom.alias("bottom")))
    return F.when(bottom - top <= band * 1.5, whole).otherwise(cut)
