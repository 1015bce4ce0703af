"""Checks of numbers and values: plain Python for Arrow operators, and the same rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the control digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12A = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12B = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def _control(digits: str, weights: tuple[int, ...]) -> str:
    return str(sum(int(d) * w for d, w in zip(digits, weights)) % 11 % 10)


def inn_valid(digits: str) -> bool:
    if len(digits) == 10:
        return digits[9] == _control(digits, INN10)
    return len(digits) == 12 and digits[10] == _control(digits, INN12A) and digits[11] == _control(digits, INN12B)


def snils_valid(digits: str) -> bool:
    return len(digits) == 11 and sum(int(d) * (9 - i) for i, d in enumerate(digits[:9])) % 101 % 100 == int(digits[9:])


def luhn_valid(digits: str) -> bool:
    if not 12 <= len(digits) <= 19:
        return False
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def luhn(digits: Column) -> Column:
    """Control digit of a card number of 12 to 19 digits."""
    return F.when(digits.rlike("^[0-9]{12,19}$"), F.call_function("luhn_check", digits)).otherwise(False)


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    return sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def inn(digits: Column) -> Column:
    ten = _weighted(digits, INN10) % 11 % 10 == F.substring(digits, 10, 1).try_cast("int")
    a = _weighted(digits, INN12A) % 11 % 10 == F.substring(digits, 11, 1).try_cast("int")
    b = _weighted(digits, INN12B) % 11 % 10 == F.substring(digits, 12, 1).try_cast("int")
    return F.when(digits.rlike("^[0-9]{10}$"), ten).when(digits.rlike("^[0-9]{12}$"), a & b).otherwise(False)


def snils(digits: Column) -> Column:
    total = _weighted(digits, tuple(range(9, 0, -1)))
    return F.when(digits.rlike("^[0-9]{11}$"), total % 101 % 100 == F.substring(digits, 10, 2).try_cast("int")).otherwise(False)


def ipv4(value: Column, leading_zeros: bool = False) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])" if not leading_zeros else "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    return value.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def service_ipv4(value: Column) -> Column:
    return value.rlike(r"^(?:127\.|0\.0\.)")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd").isNotNull()


def full_year(digits: Column, as_of_year: int) -> Column:
    """Two digits stand for the last hundred years up to `as_of_year`; NULL outside 1900 to that year. The year is a
    parameter, so results do not change with the clock."""
    n = digits.try_cast("int")
    year = F.when(F.length(digits) == 2, F.when(n <= as_of_year % 100, 2000 + n).otherwise(1900 + n)).otherwise(n)
    return F.when(year.between(1900, as_of_year), year)


def toll_free(digits: Column) -> Column:
    return digits.rlike("^[78]80[034][0-9]{7}$")


def vin(value: Column) -> Column:
    return value.rlike("^(?=.*[0-9])[0-9A-HJ-NPR-Za-hj-npr-z]{17}$")


def standard_series(letters: Column) -> Column:
    return F.lower(letters).rlike("^[авекмнорстух]+$")


def placeholder(value: Column) -> Column:
    return value.rlike(r"^\[[\p{Lu}_]+_[0-9]+\]$")


def plausible_id(value: Column) -> Column:
    """An id that may be logged: short, of plain characters, and not six digits or more alone."""
    return value.rlike(r"^[A-Za-z0-9._:\-]{1,64}$") & ~value.rlike("^[0-9]{6,}$")


def domain_zone(value: Column) -> Column:
    return value.rlike(r"\.[\p{L}]{2,}$")


def looks_like_year(value: Column) -> Column:
    """Four digits of the last or this century."""
    return value.rlike("^(?:19|20)[0-9]{2}$")
