"""Ship and equipment formulas, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(c: Column) -> Column:
    """Two decimals, half up, of the amount that eight decimals show."""
    return F.round(F.round(c, 8), 2)


def imo_state(c: Column) -> Column:
    """null (valid or missing), 'error' (not a number of at most seven digits) or 'warning' (wrong check digit)."""
    text = c.cast("string")
    padded = F.lpad(text, 7, "0")
    digit = lambda i: F.substring(padded, i + 1, 1).try_cast("int")
    total = sum((digit(i) * (7 - i) for i in range(1, 6)), digit(0) * 7)
    state = F.when(~text.rlike(r"^\d{1,7}$"), "error").when(total % 10 != digit(6), "warning")
    return F.when(text.isNotNull(), state)


def tonnage(gross: Column) -> Column:
    return F.round(gross * 1.6, 1)


def ship_age(build_year: Column, year: Column) -> Column:
    return F.when(build_year > 0, F.greatest(F.lit(0), year - build_year))


def straight_line(price: Column, residual: Column, life: Column) -> Column:
    """struct<annual, monthly>, two decimals; 0 where life isn't above 0."""
    annual = F.when(life > 0, F.try_divide(price * (1 - residual), life)).otherwise(0.0)
    return F.struct(money(annual).alias("annual"), money(annual / 12).alias("monthly"))


def double_declining(price: Column, residual: Column, life: Column) -> Column:
    """A year's charge at twice the straight rate on the price, never below the residual value."""
    floor = price * residual
    charge = F.when(life > 0, F.try_divide(price * 2.0, life)).otherwise(0.0)
    return money(F.least(charge, F.greatest(price - floor, F.lit(0.0))))


def current_value(price: Column, residual: Column, life: Column, bought: Column, as_of: Column) -> Column:
    """Price less straight-line depreciation per day, at least 0; the price where the date is unknown."""
    annual = F.when(life > 0, F.try_divide(price * (1 - residual), life)).otherwise(0.0)
    return money(F.greatest(F.lit(0.0), price - F.coalesce(annual * F.datediff(as_of, bought) / 365.25, F.lit(0.0))))


#: Named checks that field definitions can refer to: Column -> null or severity.
VALIDATORS = {"imo_validator": imo_state}
FUNCTIONS = {"straight_line": straight_line, "double_declining": double_declining, "current_value": current_value, "tonnage": tonnage, "ship_age": ship_age, "imo_validator": imo_state}


def register(name: str, fn, validator: bool = False) -> None:
    """Adds a function of columns under a name; validators give null or 'error' or 'warning'."""
    FUNCTIONS[name] = fn
    if validator:
        VALIDATORS[name] = fn
