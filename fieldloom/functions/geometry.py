"""Vectors, quaternions (w, x, y, z) and point sources as column expressions.

Vectors are arrays of three doubles.  Null in gives null out; nothing is imputed.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shared import let
from .scalar import held

NANO = 1e9
#: Magnetic constant over 4 pi, T m / A.
MU0_4PI = 1e-7


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def norm(v: Column) -> Column:
    return F.sqrt(at(v, 0) * at(v, 0) + at(v, 1) * at(v, 1) + at(v, 2) * at(v, 2))


def dot(a: Column, b: Column) -> Column:
    return at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2)


def vector(*parts: Column) -> Column:
    return F.array(*parts)


def add(a: Column, b: Column) -> Column:
    return vector(*[at(a, i) + at(b, i) for i in range(3)])


def scale(a: Column, k: Column | float) -> Column:
    return vector(*[at(a, i) * k for i in range(3)])


def rotation(q: Column) -> list[list[Column]]:
    """World-to-sensor matrix of a unit quaternion, as nine expressions."""
    w, x, y, z = (at(q, i) for i in range(4))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def world_north_nt(q: Column, sensor_field: Column) -> Column:
    """First component of the transposed rotation times a sensor's field, in nT."""
    m = rotation(q)
    return (m[0][0] * at(sensor_field, 0) + m[1][0] * at(sensor_field, 1) + m[2][0] * at(sensor_field, 2)) * NANO


def to_sensor(q: Column, world: Column) -> Column:
    m = rotation(q)
    return vector(*[m[i][0] * at(world, 0) + m[i][1] * at(world, 1) + m[i][2] * at(world, 2) for i in range(3)])


def quaternion_product(a: Column, b: Column) -> Column:
    def product(p: Column) -> Column:
        aw, ax, ay, az = (at(p["a"], i) for i in range(4))
        bw, bx, by, bz = (at(p["b"], i) for i in range(4))
        return F.array(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)

    return let(F.struct(a.alias("a"), b.alias("b")), product)


def canonical(q: Column) -> Column:
    """Unit length, w not negative."""
    length = lambda q: F.sqrt(sum((at(q, i) * at(q, i) for i in range(1, 4)), at(q, 0) * at(q, 0)))

    def scaled(p: Column) -> Column:
        sign = F.when(at(p["q"], 0) < 0, -1.0).otherwise(1.0)
        return F.when(p["n"] > 0, F.array(*[at(p["q"], i) / p["n"] * sign for i in range(4)]))

    return let(let(q, lambda q: F.struct(q.alias("q"), length(q).alias("n"))), scaled)


def radical_inverse(n: Column, base: int, digits: int = 32) -> Column:
    """Van der Corput sequence."""
    start = F.struct(n.cast("long").alias("n"), F.lit(1.0 / base).alias("f"), F.lit(0.0).alias("x"))
    step = lambda s, _: F.struct(F.floor(s["n"] / base).cast("long").alias("n"), (s["f"] / base).alias("f"), (s["x"] + (s["n"] % base) * s["f"]).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda s: s["x"])


def spread_pose(n: Column, shifts: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """The n-th of evenly spread orientations, from radical inverses in bases 2, 3 and 5."""
    u, v, w = (F.pmod(radical_inverse(n, b) + s, F.lit(1.0)) for b, s in zip((2, 3, 5), shifts, strict=True))
    a, b = F.sqrt(1 - u), F.sqrt(u)
    return canonical(F.array(b * F.cos(2 * pi * w), a * F.sin(2 * pi * v), a * F.cos(2 * pi * v), b * F.sin(2 * pi * w)))


def dipole(position: Column, moment: Column, sensor: Column, nearest: Column | float) -> Column:
    """Field of a point dipole; null where the sensor is not farther away than `nearest`."""
    d = vector(*[at(sensor, i) - at(position, i) for i in range(3)])
    r = norm(d)
    along = 3 * dot(moment, d) / F.pow(r, F.lit(5.0))
    return F.when(r > nearest, vector(*[MU0_4PI * (along * at(d, i) - at(moment, i) / F.pow(r, F.lit(3.0))) for i in range(3)]))


def gaussian_anomaly(center: Column, amplitude: Column, width: Column, sensor: Column) -> Column:
    d = vector(*[at(sensor, i) - at(center, i) for i in range(3)])
    return scale(amplitude, F.exp(-dot(d, d) / (2 * width * width)))


def periodic(amplitude: Column, hz: Column, phase: Column, t: Column) -> Column:
    return scale(amplitude, F.sin(2 * pi * hz * t + phase))


def gradient(matrix: Column, sensor: Column) -> Column:
    return vector(*[dot(at(matrix, i), sensor) for i in range(3)])


def total(*fields: Column) -> Column:
    """Sum of fields, null if any is: one invalid source makes the reading invalid."""
    out = fields[0]
    for f in fields[1:]:
        out = add(out, f)
    return F.when(~F.exists(out, lambda x: x.isNull()), out)


def clip(v: Column, limit: Column | float) -> Column:
    """struct<v, mask>: components held to +-limit, and which were."""
    parts = [at(v, i) for i in range(3)]
    return F.struct(vector(*[held(p, -F.lit(limit), F.lit(limit)) for p in parts]).alias("v"), F.array(*[F.abs(p) > limit for p in parts]).alias("mask"))


AXES = {"x": 0, "y": 1, "z": 2}


def channel(v: Column, mask: Column, which: str) -> Column:
    """struct<value, clipped>: one axis or the magnitude of a vector, and whether what it rests on is clipped."""
    if which == "magnitude":
        return F.struct(norm(v).alias("value"), F.exists(mask, lambda x: x).alias("clipped"))
    return F.struct(at(v, AXES[which]).alias("value"), F.get(mask, F.lit(AXES[which])).alias("clipped"))


def project(v: Column, mode: str, axis: Column | None = None) -> Column:
    """What a sensor of a mode reports: all components, the component along its axis, or the total field."""
    if mode == "vector":
        return v
    return F.array(dot(v, axis) if mode == "monoaxial" else norm(v))


def integrate(q: Column, rate: Column, dt: Column | float) -> Column:
    """The world-to-sensor orientation after the sensor has turned at a constant rate (rad/s, in its own frame) for dt seconds."""

    def turn(r: Column) -> Column:
        half = r["speed"] * dt / 2
        part = F.when(r["speed"] > 0, F.sin(half) / r["speed"]).otherwise(0.0)
        return F.array(F.cos(half), *[at(r["rate"], i) * part for i in range(3)])

    return canonical(quaternion_product(let(let(rate, lambda r: F.struct(r.alias("rate"), norm(r).alias("speed"))), turn), q))
