"""Closed-form loan arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _growth(annual_rate_pct: Column, years: Column) -> tuple[Column, Column, Column]:
    rate = annual_rate_pct / 1200.0
    months = years * 12
    return rate, months, F.pow(1 + rate, months)


def monthly_payment(principal, annual_rate_pct, years) -> Column:
    principal, annual_rate_pct, years = _col(principal), _col(annual_rate_pct), _col(years)
    rate, months, growth = _growth(annual_rate_pct, years)
    annuity = principal * rate * growth / F.nullif(growth - 1, F.lit(0.0))
    return F.when(rate == 0, principal / months).otherwise(annuity)


def loan_for_payment(payment, annual_rate_pct, years) -> Column:
    payment, annual_rate_pct, years = _col(payment), _col(annual_rate_pct), _col(years)
    rate, months, growth = _growth(annual_rate_pct, years)
    annuity = payment * (growth - 1) / F.nullif(rate * growth, F.lit(0.0))
    return F.when(rate == 0, payment * months).otherwise(annuity)


def required_rate(principal, payment, years, high: float = 12.0, steps: int = 60) -> Column:
    """Annual rate in percent at which the payment carries the principal, by bisection."""
    principal, payment, years = _col(principal), _col(payment), _col(years)

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        too_dear = monthly_payment(principal, middle, years) > payment
        lower = F.struct(state["lo"].alias("lo"), middle.alias("hi"))
        upper = F.struct(middle.alias("lo"), state["hi"].alias("hi"))
        return F.when(too_dear, lower).otherwise(upper)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float(high)).alias("hi"))
    rate = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    hopeless = (principal <= 0) | (principal / (years * 12) > payment)
    return F.when(hopeless, F.lit(0.0)).otherwise(F.rint(rate * 100) / 100)
