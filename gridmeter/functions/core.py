"""Column helpers that pin down pandas/NumPy semantics in native expressions.

All helpers return ``Column`` expressions (JVM side, whole-stage codegen);
none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- NULL / NaN
def nan_to_null(c: ColumnOrName) -> Column:
    """NaN -> NULL, so that comparisons behave like NumPy (NaN >= 0 is False)."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def neq_nullsafe(c: ColumnOrName, value) -> Column:
    """pandas ``s != value``: NULL rows are kept (NaN != 1 is True)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def not_in_nullsafe(c: ColumnOrName, values) -> Column:
    """pandas ``~s.isin(values)``: NULL rows are kept."""
    return ~F.coalesce(_c(c).isin(list(values)), F.lit(False))


def contains_ci(c: ColumnOrName, pattern: str) -> Column:
    """pandas ``str.contains(p, case=False, na=False)`` (regex search)."""
    return F.coalesce(_c(c).rlike("(?i)" + pattern), F.lit(False))


def drop_null_keys(df: DataFrame, keys) -> DataFrame:
    """pandas ``groupby`` drops rows with a NULL key."""
    return df.dropna(subset=list(keys))


# ---------------------------------------------------------------- coercion
_NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[Nn]a[Nn]|[Ii]nf(inity)?)\s*$"


def to_number(df: DataFrame, name: str) -> Column:
    """``pd.to_numeric(errors='coerce')`` for one column of ``df``.

    Strings that are not plain numbers become NULL (``try_cast`` alone would
    accept Java suffix forms such as ``'1d'``).
    """
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, NumericType):
        return c.cast("double")
    if isinstance(dt, StringType):
        return F.when(c.rlike(_NUMBER_RE), F.expr(f"try_cast(`{name}` AS DOUBLE)"))
    return F.expr(f"try_cast(`{name}` AS DOUBLE)")


def to_timestamp_utc(df: DataFrame, name: str) -> Column:
    """``pd.to_datetime(errors='coerce')``: strings/NTZ -> TIMESTAMP (UTC)."""
    dt = df.schema[name].dataType.simpleString()
    if dt == "timestamp":
        return F.col(name)
    if dt in ("timestamp_ntz", "date"):
        return F.col(name).cast("timestamp")
    return F.expr(f"try_to_timestamp(`{name}`)")


# ---------------------------------------------------------------- rounding
def round_half_up(c: ColumnOrName, digits: int) -> Column:
    """Deterministic output rounding: ``floor(x*10^d + 0.5)/10^d``.

    The same formula is used by the SQL oracles, so both engines round the
    same bits the same way (a tiny bias absorbs last-bit differences from
    a different summation order).
    """
    s = float(10 ** digits)
    t = _c(c) * s
    return (F.floor(t + F.lit(0.5 + 1e-7) + F.abs(t) * F.lit(1e-11)) / s).cast("double")


def sql_round(expr: str, digits: int) -> str:
    """SQL text of :func:`round_half_up` (for DuckDB / Spark SQL)."""
    s = float(10 ** digits)
    t = f"(({expr}) * {s})"
    return f"CAST(floor({t} + {0.5 + 1e-7} + abs({t}) * 1e-11) / {s} AS DOUBLE)"


def round_half_even(c: ColumnOrName, digits: int = 0) -> Column:
    """``np.round``: half to even."""
    return F.bround(_c(c), digits)


# ---------------------------------------------------------------- order
def ordered_bits(c: ColumnOrName) -> Column:
    """A double as the 64-bit integer of the same order: the IEEE bits of its
    size, negated for negative values (both zeros are 0, infinities lie
    outside all numbers and NaN above them, as Spark orders)."""
    x, size = _c(c), F.abs(_c(c))
    whole, half = F.lit(float(2 ** 52)), F.lit(2.0 ** 537)
    guess = F.floor(F.log2(F.when(size < F.lit(2.0 ** -1022), 1.0).otherwise(F.least(size, F.lit(1.7976931348623157e308)))))
    guess = F.least(F.greatest(guess, F.lit(-1022)), F.lit(1023))
    power = F.pow(F.lit(2.0), guess.cast("double"))
    # the logarithm may be off by one beside a power of two
    up, down = size / power >= 2, size / power < 1
    exponent = guess + F.when(up, 1).when(down, -1).otherwise(0)
    mantissa = size / F.when(up, power * 2).when(down, power / 2).otherwise(power) - 1
    bits = (F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(size == float("inf"), F.lit(2047 << 52))
             .when(size < F.lit(2.0 ** -1022), (size * half * half).cast("long"))      # 2^1074 in two steps
             .otherwise((exponent + 1023) * F.lit(1 << 52) + (mantissa * whole).cast("long")))
    return F.when(x < 0, -bits).otherwise(bits)


# ---------------------------------------------------------------- time
def epoch_micros(c: ColumnOrName) -> Column:
    return F.unix_micros(_c(c))


def month_ordinal(c: ColumnOrName) -> Column:
    """pandas ``Period('M').ordinal`` = (year-1970)*12 + month-1."""
    return (F.year(_c(c)) - 1970) * 12 + F.month(_c(c)) - 1


def year_month(c: ColumnOrName) -> Column:
    """Month label ``yyyy-MM`` (pandas ``Period[M]`` printed)."""
    return F.date_format(_c(c), "yyyy-MM")


def slot_of_day(c: ColumnOrName, slot_minutes: int = 15) -> Column:
    """0-based slot index of the UTC time of day (floor of seconds)."""
    sec = F.unix_seconds(_c(c))
    return F.floor(F.pmod(sec, F.lit(86400)) / F.lit(slot_minutes * 60)).cast("int")
