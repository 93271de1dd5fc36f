"""Compartment-model parameters and response surfaces as column expressions.

A parameter column is a struct of v1, v2, v3 (litres) and k10, k12, k13, k21, k31, ke0 (1/min). Weights are in kg, heights in cm,
ages in years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("v1", "v2", "v3", "k10", "k12", "k13", "k21", "k31", "ke0")


def _struct(*values: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*[as_col(v).alias(n) for n, v in zip(NAMES, values, strict=True)])


def _from_clearances(v1, v2, v3, cl1, cl2, cl3, ke0) -> Column:
    one = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    v1, v2, v3, cl1, cl2, cl3 = map(one, (v1, v2, v3, cl1, cl2, cl3))
    return _struct(v1, v2, v3, cl1 / v1, cl2 / v1, cl3 / v1, cl2 / v2, cl3 / v3, ke0)


# The numbers of the published models below are fixed values.


def marsh(weight: Column) -> Column:
    return _struct(weight * 0.228, weight * 0.463, weight * 2.893, 0.119, 0.112, 0.0419, 0.055, 0.0033, 0.26)


def schnider(weight: Column, age: Column, height: Column, male: Column) -> Column:
    from .scalar import lean_mass

    cl1 = 1.89 + 0.0456 * (weight - 77) - 0.0681 * (lean_mass(weight, height, male) - 59) + 0.0264 * (height - 177)
    return _from_clearances(4.27, 18.9 - 0.391 * (age - 53), 238.0, cl1, 1.29 - 0.024 * (age - 53), 0.836, 0.456)


def fat_free_mass(weight: Column, height: Column, male: Column) -> Column:
    m2 = height / 100 * height / 100
    bmi = weight / m2
    return F.when(male, (0.88 * weight + 12.8 * m2) / (1 + 0.0273 * bmi)).otherwise((1.11 * weight + 7.52 * m2) / (1 + 0.0236 * bmi))


def eleveld(weight: Column, age: Column, height: Column, male: Column) -> Column:
    reference = 0.88 * 70 + 12.8 * 1.7**2 / (1 + 0.0273 * (70 / 1.7**2))
    size = fat_free_mass(weight, height, male) / F.lit(reference)
    slow = F.pow(size, F.lit(0.75))
    older = F.pow(F.greatest(age, F.lit(18.0)) / 35, F.lit(-0.446))
    return _from_clearances(6.28 * size, 25.5 * size, 273.0 * size, 1.79 * slow * older, 1.75 * slow, 1.11 * slow, 0.146 * F.pow(age / 35, F.lit(-0.25)))


def minto(weight: Column, age: Column, height: Column, male: Column) -> Column:
    bmi = weight / (height / 100 * height / 100)
    lean = 9270 * weight / F.when(male, 6680 + 216 * bmi).otherwise(8780 + 244 * bmi)
    v1 = 5.1 - 0.0201 * (age - 40) + 0.0722 * (lean - 50)
    v2 = 9.82 - 0.0811 * (age - 40) + 0.108 * (lean - 50)
    return _struct(v1, v2, 5.42, 0.595 - 0.007 * (age - 40), 0.476, 0.212, 0.403 - 0.0026 * (age - 40), 0.029, 0.6)


def wierda(weight: Column) -> Column:
    return _struct(weight * 0.07, weight * 0.13, 1.0, 0.0037 / 0.07, 0.093, 0.0, 0.093 * 0.07 / 0.13, 0.0, 0.105)


def depth_index(a: Column, b: Column, gas: Column, arousal: Column, half: tuple[float, float, float], gamma: float, top: float, low: float) -> Column:
    """A response surface of two drugs and a gas with weak interactions, lowered by arousal (0.03 units a point)."""
    ua, ub, ug = a / half[0], b / half[1], gas / half[2]
    u = F.greatest(ua + ub + ug + 0.05 * ua * ub + 0.05 * ua * ug - arousal * 0.03, F.lit(-5.0))
    p = F.pow(F.greatest(u, F.lit(0.0)), F.lit(float(gamma)))
    return F.least(F.greatest(F.lit(top) - F.lit(top - low) * p / (1 + p), F.lit(0.0)), F.lit(100.0))


def end_tidal(tidal: Column, dead: Column, rate: Column, vco2: Column, load: Column, k: float = 863.0) -> Column:
    """End-tidal CO2 of alveolar ventilation (at least 500 ml/min); the arterial pressure ends at 0 and 90."""
    arterial = vco2 * k / F.greatest((tidal - dead) * rate, F.lit(500.0)) * F.pow(load, F.lit(0.8))
    return F.least(F.greatest(arterial, F.lit(0.0)), F.lit(90.0)) * 0.95


def peak_pressure(tidal: Column, compliance: Column, resistance: Column, flow: Column, peep: Column) -> Column:
    return tidal / compliance + resistance * flow + peep
