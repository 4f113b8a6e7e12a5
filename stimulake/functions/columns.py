"""Scalar functions of responses and geometry, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(x: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave null alone."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def noise_ceiling(ncsnr: Column, repeats: int = 3) -> Column:
    """Share of variance that a noiseless model could explain of a mean over repeats; 0 becomes 1e-14."""
    squared = ncsnr * ncsnr
    ceiling = squared / (squared + F.lit(1.0 / repeats))
    return F.when(ceiling == 0, F.lit(1e-14)).otherwise(ceiling)


def explained_variance(r2: Column, ceiling: Column) -> Column:
    """Percent of the explainable variance, 100 at most."""
    return clip(r2 / ceiling * 100, high=100.0)


def signed_log(x: Column) -> Column:
    return F.log1p(F.abs(x)) * F.tanh(x)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def angle_delta(a: Column, b: Column) -> Column:
    """Signed difference a - b brought into [-pi, pi)."""
    return F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi


def gaussian(x: Column, y: Column, x0: Column | float, y0: Column | float, sigma: Column | float, pixel: float = 1.0) -> Column:
    """Isotropic density times the pixel's area."""
    dx, dy = x - x0, y - y0
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return F.lit(pixel * pixel) / (2 * math.pi * sigma * sigma) * F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))


def rotated_gaussian(x: Column, y: Column, x0: Column | float, y0: Column | float, log_sx: Column | float, log_sy: Column | float, theta: Column | float, log_amplitude: Column | float, offset: Column | float = 0.0) -> Column:
    """Anisotropic bump over an offset, turned clockwise by theta; widths and amplitude are given as logarithms."""
    x0, y0, log_sx, log_sy, theta, log_amplitude, offset = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x0, y0, log_sx, log_sy, theta, log_amplitude, offset))
    c, s = F.cos(theta), F.sin(theta)
    u, v = (x - x0) * c - (y - y0) * s, (x - x0) * s + (y - y0) * c
    return offset + F.exp(log_amplitude) * F.exp(-(u * u * F.exp(-2 * log_sx) + v * v * F.exp(-2 * log_sy)) / 2)


def orientation_delta(x0: Column, y0: Column, log_sx: Column, log_sy: Column, theta: Column) -> Column:
    """Smallest signed difference between a field's polar angle and the direction of its longer axis, which has two ends."""
    turned = F.pmod(-(theta + F.when(log_sx < log_sy, math.pi / 2).otherwise(0.0)), F.lit(2 * math.pi)) - math.pi
    other = F.when(turned > 0, turned - math.pi).otherwise(turned + math.pi)
    a, b = angle_delta(turned, F.atan2(y0, x0)), angle_delta(other, F.atan2(y0, x0))
    return F.when(F.abs(a) < F.abs(b), a).otherwise(b)


def ratio_error(part: Column, part_error: Column, whole: Column, whole_error: Column) -> Column:
    """Standard error, in percent, of part squared over whole squared, by first-order propagation."""
    relative = lambda v, e: F.try_divide(e, v) * F.try_divide(e, v)
    return 200 * F.try_divide(part * part, whole * whole) * F.sqrt(relative(whole, whole_error) + relative(part, part_error))


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that follows from the key and a seed: the same in every run, whatever the partitions."""
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0


def hashed_normal(key: Column, seed: int) -> Column:
    """A standard normal number that follows from the key and a seed."""
    return F.sqrt(-2 * F.log(hashed_uniform(key, 2 * seed))) * F.cos(2 * math.pi * hashed_uniform(key, 2 * seed + 1))


def pruning_mask(key: Column, ratio: float, seed: int) -> Column:
    """Whether a feature is kept; a share ``ratio`` of the keys is not, all of them at 1."""
    return hashed_uniform(key, seed) >= ratio


def string_seed(subject: Column, name: Column) -> Column:
    """100 times the subject plus the sum of character codes."""
    return subject * 100 + F.aggregate(F.transform(F.filter(F.split(name, ""), lambda c: c != ""), F.ascii), F.lit(0), lambda a, c: a + c)


def unit_norm(v: Column) -> Column:
    """An array scaled to Euclidean length 1; a zero vector gives nulls."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.try_divide(x, norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def one_hot(x: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == x, 1).otherwise(0))
