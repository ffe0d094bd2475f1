"""Planck conversions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe import codes
from emberframe.functions.nulls import clip, holds


@dataclass(frozen=True)
class BandCoefficients:
    """The four calibration columns of one band."""

    fk1: Column
    fk2: Column
    bc1: Column
    bc2: Column

    @classmethod
    def of(cls, band: int | str) -> "BandCoefficients":
        return cls(*(F.col(f"{n}_{band}") for n in ("fk1", "fk2", "bc1", "bc2")))

    @classmethod
    def chosen(cls, condition: Column, yes: "BandCoefficients", no: "BandCoefficients") -> "BandCoefficients":
        pick = lambda n: F.when(holds(condition), getattr(yes, n)).otherwise(getattr(no, n))
        return cls(*(pick(n) for n in ("fk1", "fk2", "bc1", "bc2")))


def temperature_of(rad: Column, k: BandCoefficients) -> Column:
    """Radiance to brightness temperature; NULL for radiance <= 0."""
    return F.when(rad > 0, (k.fk2 / F.log1p(k.fk1 / rad) - k.bc1) / k.bc2)


def radiance_of(temp: Column, k: BandCoefficients) -> Column:
    return F.when(temp > 0, k.fk1 / F.expm1(k.fk2 / (temp * k.bc2 + k.bc1)))


def radiance_slope(temp: Column, fraction: Column, k: BandCoefficients) -> Column:
    """d(fraction * L)/dT in the calibrated form."""
    shifted = temp * k.bc2 + k.bc1
    decay = F.exp(-k.fk2 / shifted)
    slope = k.fk1 * k.fk2 * k.bc2 * decay / (shifted * shifted * (1 - decay) * (1 - decay))
    return F.when((temp > 0) & (shifted > 0) & fraction.between(0, 1), fraction * slope)


def _c1() -> float:
    return 2.0 * codes.PLANCK_H * codes.LIGHT_C**2


def _c2() -> float:
    return codes.PLANCK_H * codes.LIGHT_C / codes.BOLTZMANN_K


def mono_radiance(temp: Column, wavelength: Column) -> Column:
    """Monochromatic Planck law, W per m2, sr and m."""
    return F.when(temp > 0, F.lit(_c1()) / (F.pow(wavelength, 5) * (F.exp(F.lit(_c2()) / (wavelength * temp)) - 1)))


def mono_temperature(rad: Column, wavelength: Column) -> Column:
    return F.when(rad > 0, (F.lit(_c2()) / wavelength) / F.log1p(F.lit(_c1()) / (rad * F.pow(wavelength, 5))))


def mono_slope(temp: Column, fraction: Column, wavelength: Column) -> Column:
    grown = F.exp(F.lit(_c2()) / (wavelength * temp))
    return fraction * _c1() * _c2() / (F.pow(wavelength, 6) * temp * temp) * grown / ((grown - 1) * (grown - 1))


def native_to_si(rad: Column, wavelength_m: float) -> Column:
    """mW/(m2 sr cm-1) to W/(m2 sr m)."""
    return rad * F.lit(1e-5 / wavelength_m**2)


def reflectance_of(rad: Column, kappa: Column) -> Column:
    return clip(kappa * rad, 0.0, 1.5)
