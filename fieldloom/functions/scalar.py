"""Scalar maps: scaling, phases, scores, clocks, identifiers."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def held(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within bounds; null stays null, which greatest() and least() alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def angle(x: Column, mean: Column, sd: Column) -> Column:
    """Bounded angle of a standardised value; a spread of 1e-12 or less counts as 1."""
    return pi / 2 * F.tanh((x - mean) / F.when(sd > 1e-12, sd).otherwise(1.0) / 2)


def wrap_phase(p: Column) -> Column:
    """A phase in [-pi, pi)."""
    return F.pmod(p + pi, F.lit(2 * pi)) - pi


def circle(p: Column) -> Column:
    return F.array(F.sin(p), F.cos(p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-held(z, -709.0, 709.0)))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def ratio_db(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), 10 * F.log10(F.greatest(a, F.lit(floor)) / F.greatest(b, F.lit(floor))))


def snr_db(periodic: Column, residual: Column, most: float = 300.0) -> Column:
    """Decibels of two powers: 0 if both vanish, held to +-most."""
    floor = EPS * F.greatest(periodic, residual, F.lit(1.0))
    db = 10 * F.log10(F.greatest(periodic, floor) / F.greatest(residual, floor))
    return F.when((periodic <= floor) & (residual <= floor), 0.0).when(periodic.isNotNull() & residual.isNotNull(), held(db, -most, most))


def acquisition_micros(epoch_micros: Column, t: Column, offset_s: Column, ppm: Column) -> Column:
    """Micros of a node's own clock, which is off by an offset and a rate."""
    return epoch_micros + F.rint((offset_s + t * (1 + ppm * 1e-6)) * 1e6).cast("long")


def sample_index(t: Column, start: Column, hz: float) -> Column:
    """Nearest sample, ties to even."""
    return F.rint((t - start) * hz).cast("long")


def window_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with names in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def iso_utc(t: Column) -> Column:
    """ISO-8601 text of a timestamp in UTC, to the microsecond (the session's time zone is UTC)."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_iso(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X")


def age_ms(t: Column, now: Column) -> Column:
    """Whole milliseconds from t to now."""
    return F.floor((F.unix_micros(now) - F.unix_micros(t)) / 1000).cast("long")


def identifier(x: Column) -> Column:
    """Whether an id is a lower-case letter and at most 31 letters, digits, ':', '_' or '-'."""
    return x.rlike("^[a-z][a-z0-9:_-]{0,31}$")


def uncertain(scores: Column, least: float = 0.70, margin: float = 0.15) -> Column:
    """Whether the top score is low or the second close."""
    top = F.sort_array(scores, asc=False)
    return (F.get(top, F.lit(0)) < least) | (F.get(top, F.lit(0)) - F.get(top, F.lit(1)) < margin)
