"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan0(c: Column) -> Column:
    """Null and NaN as 0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(c, F.lit(float(hi)))))


def log_radiance(c: Column) -> Column:
    return F.ln(F.greatest(nan0(c), F.lit(0.0)) + 1.0)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -50, 50)))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1.0 - q))


def entropy_bits(p: Column) -> Column:
    """Entropy of a chance in bits, 0 at 0 and 1."""
    inner = -(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p))
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(inner)


def normalised_difference(a: Column, b: Column) -> Column:
    return clip((a - b) / F.greatest(a + b, F.lit(1e-4)), -1, 1)


def percent_difference(a: Column, b: Column) -> Column:
    return F.try_divide(100.0 * (a - b), b)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    r = F.radians
    h = F.pow(F.sin((r(lat2) - r(lat1)) / 2), F.lit(2.0)) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), F.lit(2.0))
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180.0) / 6.0) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("long")


def epoch_at(year: Column) -> Column:
    return F.least(F.lit(2020), F.floor(year / 5) * 5).cast("long")


def month_window(year: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """A season that starts the year before: first day of its first month, last day of its last."""
    form = lambda c: F.date_format(c, "yyyy-MM-dd")
    return form(F.make_date(year - 1, first, F.lit(1))), form(F.last_day(F.make_date(year, last, F.lit(1))))


def per_m2(amount: Column, side: float) -> Column:
    """An amount per square cell of this side as a density."""
    return amount / (side * side)


def per_cell(density: Column, side: float) -> Column:
    return density * (side * side)


def mollweide(lon: Column, lat: Column, radius: float = 6371007.181) -> tuple[Column, Column]:
    """x and y of the equal-area projection, by five Newton steps for the auxiliary angle (not at the poles)."""
    phi = F.radians(lat)
    steps = F.sequence(F.lit(1), F.lit(5))
    theta = F.aggregate(steps, phi * 0.8, lambda t, _: t - (2 * t + F.sin(2 * t) - F.pi() * F.sin(phi)) / (2 + 2 * F.cos(2 * t)))
    k = radius * 2**0.5
    return k * 2 / F.pi() * F.radians(lon) * F.cos(theta), k * F.sin(theta)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution: a power series near 0, from 4 on a continued fraction; right to 1e-14 and more."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / F.sqrt(2 * F.pi())
    start = F.struct(a.alias("term"), a.alias("sum"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * a * a / (2 * k + 1)).alias("sum")), lambda s: s["sum"])
    far = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda x, k: a + k / x)
    tail = F.when(a < 4, 0.5 - density * near).otherwise(density / far)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0: Stirling's series at x + 8, brought back by the product of the steps between."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    steps = F.ln(x)
    for k in range(1, 8):
        steps = steps + F.ln(x + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.5 * F.ln(2 * F.pi()) + series - steps


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 < x < 1, by its continued fraction (taken from the end, in as many steps as a and b ask for)."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        steps = (40 + 4 * F.sqrt(F.greatest(a, b))).cast("int")
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, m: 1 + even(m) / (1 + odd(m) / f))
        front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
        return front / a / (1 + odd(F.lit(0)) / down)

    return F.when(x < (a + 1) / (a + b + 2), fraction(x, a, b)).otherwise(1 - fraction(1 - x, b, a))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_html(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))


def student_p(t: Column, df: Column, sums: int = 60) -> Column:
    """Two-sided p-value of Student's t: for whole degrees of freedom up to `sums` by the closed finite sums, for all others by the incomplete beta function."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    s, c = F.sin(theta), F.cos(theta)
    step = lambda first, last, fac: F.aggregate(
        F.when(last >= first, F.sequence(F.lit(first), last, F.lit(2))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, k: F.struct((a["term"] * fac(k) * c * c).alias("term"), (a["sum"] + a["term"] * fac(k) * c * c).alias("sum")),
        lambda a: a["sum"],
    )
    n = df.cast("int")
    even = s * step(2, n - 2, lambda k: (k - 1) / k.cast("double"))
    odd = F.when(n == 1, 2 * theta / F.pi()).otherwise(2 / F.pi() * (theta + s * c * step(3, n - 2, lambda k: (k - 1) / k.cast("double"))))
    inside = F.when(n % 2 == 0, even).otherwise(odd)
    d = df.cast("double")
    beta = F.when(t == 0, 1.0).otherwise(beta_share(d / (d + t * t), d / 2, F.lit(0.5)))
    return F.when(d <= 0, F.lit(None)).when((n <= sums) & (n == d), F.greatest(F.lit(0.0), 1 - inside)).otherwise(beta)


# Fixed values of the WGS 84 ellipsoid and of the universal grid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10000000.0


def krueger(n: float) -> tuple[float, list[float], list[float]]:
    """Krueger's series to the fourth order of the third flattening: the rectifying radius over the axis, and the forward and backward coefficients."""
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    backward = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return (1 + n**2 / 4 + n**4 / 64) / (1 + n), forward, backward


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing of a longitude and latitude in a zone of the universal transverse Mercator grid."""
    radius, forward, _ = krueger(WGS84_F / (2 - WGS84_F))
    e = (WGS84_F * (2 - WGS84_F)) ** 0.5
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(forward, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = UTM_SCALE * WGS84_A * radius
    return UTM_EAST + k * x, k * y + F.when(south, UTM_SOUTH).otherwise(0.0)


def utm_back(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing; the latitude by six steps of fixed point iteration on the conformal one."""
    radius, _, backward = krueger(WGS84_F / (2 - WGS84_F))
    e = (WGS84_F * (2 - WGS84_F)) ** 0.5
    k = UTM_SCALE * WGS84_A * radius
    xi, eta = (north - F.when(south, UTM_SOUTH).otherwise(0.0)) / k, (east - UTM_EAST) / k
    x, y = eta, xi
    for j, c in enumerate(backward, 1):
        x = x - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    conformal = F.atanh(F.sin(y) / F.cosh(x))
    sine = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.tanh(conformal), lambda s, _: F.tanh(conformal + e * F.atanh(e * s)))
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + zone * 6 - 183, F.degrees(F.asin(sine))
