"""Column expressions for binding energies and occupancies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kmerlake.functions.sequence import col

GAS_CONSTANT = 8.314459848 / 4.184e3  # kcal / (mol K)


def rt(celsius: float) -> float:
    """RT in kcal/mol."""
    return (celsius + 273.15) * GAS_CONSTANT


def kd_to_energy(kd_nm: str | Column, celsius: float = 22.0) -> Column:
    return F.log(col(kd_nm) / 1e9) * rt(celsius)


def energy_to_kd(kcal: str | Column, celsius: float = 22.0) -> Column:
    return F.exp(col(kcal) / rt(celsius)) * 1e9


def occupancy(protein: str | Column, kd: str | Column) -> Column:
    return col(protein) / (col(protein) + col(kd))


def bound_probability(z: str | Column) -> Column:
    return col(z) / (col(z) + 1)


def accessibility(energy: str | Column, celsius: float = 4.0, scale: float = 1.0) -> Column:
    """Boltzmann weight of being unpaired."""
    return F.exp(-col(energy) * scale / rt(celsius))


def power_scale(x: str | Column, a: float) -> Column:
    """x ** a as exp(a ln x); null where x is not positive."""
    return F.when(col(x) > 0, F.exp(F.log(col(x)) * a))


def normalised_signal(sensor: Column, folded: Column, unfolded: Column) -> Column:
    """Fluorescence between its folded and unfolded references."""
    return (sensor - folded) / (unfolded - folded)
