"""Column expressions that turn sheet text into typed values.

All of them are native Spark expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must match the source behaviour.
# Shift codes and their labels.
SHIFT_LABELS = {"1": "Turno A", "2": "Turno B"}
# Portuguese weekday names by English name.
WEEKDAY_PT = {
    "Monday": "Segunda-feira",
    "Tuesday": "Terca-feira",
    "Wednesday": "Quarta-feira",
    "Thursday": "Quinta-feira",
    "Friday": "Sexta-feira",
    "Saturday": "Sabado",
    "Sunday": "Domingo",
}
# Text the machine column carries on subtotal rows.
SUBTOTAL_MARK = "Turno"
# Scheduled hours per day and total hours per day (TEEP factor).
SCHEDULED_HOURS = 16.0
TOTAL_HOURS = 24.0

# A plain decimal number: what a strict number parser accepts after trimming.
# Spark's cast alone also accepts "5d"/"5f" suffixes and "nan"; this guard rejects them.
NUMERIC_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's str.strip() removes (its whitespace set).
PY_WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(c: Column | str) -> Column:
    """Trim leading/trailing whitespace like Python's ``str.strip()`` (a character-set
    trim, no regex)."""
    return F.btrim(_col(c).cast("string"), F.lit(PY_WHITESPACE))


def number_or_null(c: Column | str) -> Column:
    """Strict text -> double: trimmed plain decimal or null (C6 core)."""
    t = strip_ws(c)
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))


def percent_fraction(c: Column | str, bad_as_zero: bool = True) -> Column:
    """``"41,65%"`` -> 0.4165.  Drop ``%``, comma becomes dot, trim, parse,
    divide by 100. Unparseable (or null) text gives 0 (C1) or null (C2)."""
    text = strip_ws(F.replace(F.replace(_col(c).cast("string"), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))
    value = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double") / F.lit(100.0))
    if bad_as_zero:
        value = F.coalesce(value, F.lit(0.0))
    return value


DATE_SHAPE = r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{2}|[0-9]{4}))$"
COMPACT_DATE = r"^[0-9]{8}$"
# day month-name year, or month-name day year; English names or their first three letters
NAMED_DAY_FIRST = r"(?i)^([0-9]{1,2})[ /.-]*([a-z]{3,9})[ ,/.-]*([0-9]{4}|[0-9]{2})$"
NAMED_MONTH_FIRST = r"(?i)^([a-z]{3,9})[ /.-]*([0-9]{1,2})[ ,/.-]+([0-9]{4}|[0-9]{2})$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TIME_TAIL = r"(?i)([ t]+[0-9]{1,2}:[0-9]{2}.*)$"  # a time of day and what follows it


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """Date from text parts via a non-throwing cast (invalid day/month -> null)."""
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _full_year(y: Column) -> Column:
    """Two-digit years: 69 to 99 are 19yy, 00 to 68 are 20yy."""
    return F.when(F.length(y) != 2, y).when(y >= "69", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))


def _month_number(name: Column) -> Column:
    """Number of an English month name or its first three letters, as text; else null."""
    low = F.lower(name)
    out = None
    for i, month in enumerate(MONTHS, 1):
        hit = low.isin(month, month[:3], *(["sept"] if month == "september" else []))
        out = F.when(hit, F.lit(str(i))) if out is None else out.when(hit, F.lit(str(i)))
    return out


def day_first_date(c: Column | str) -> Column:
    """Mixed-format, day-first date text -> DATE, bad -> null.

    ``yyyy-mm-dd`` (or ``yyyy/mm/dd``) stays year first; otherwise day first; an impossible
    day-first reading (month > 12) falls back to month first; two-digit years are 1969 to
    2068; ``-``, ``/`` and ``.`` separators are accepted; ``yyyymmdd`` and English month names,
    too; a time of day after a space or ``T`` is ignored. Parsing splits the text into
    numbers and casts an ISO string, so a non-matching form costs no exception.
    """
    head = F.regexp_replace(strip_ws(c), TIME_TAIL, "")
    parts = F.split(head, "[-/.]")
    p1, p2, p3 = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    year = _full_year(p3)
    year_first = _ymd(p1, p2, p3)
    day_first = F.coalesce(_ymd(year, p2, p1), _ymd(year, p1, p2))
    compact = _ymd(head.substr(1, 4), head.substr(5, 2), head.substr(7, 2))

    def named(pattern: str, day: int, month: int) -> Column:
        y, m, d = (F.regexp_extract(head, pattern, i) for i in (3, month, day))
        return _ymd(_full_year(y), _month_number(m), d)

    return (
        F.when(head.rlike(DATE_SHAPE), F.when(F.length(p1) == 4, year_first).otherwise(day_first))
        .when(head.rlike(COMPACT_DATE), compact)
        .when(head.rlike(NAMED_DAY_FIRST), named(NAMED_DAY_FIRST, 1, 2))
        .when(head.rlike(NAMED_MONTH_FIRST), named(NAMED_MONTH_FIRST, 2, 1))
    )


def shift_code(c: Column | str) -> Column:
    """Text before the first ``.`` of the shift cell (``1.0`` -> ``1``)."""
    return F.substring_index(_col(c).cast("string"), ".", 1)


def shift_label(c: Column | str, labels: dict[str, str] | None = None) -> Column:
    """C4: shift code -> label; any other code -> null."""
    labels = labels or SHIFT_LABELS
    code = shift_code(c)
    out = None
    for k, v in labels.items():
        out = F.when(code == k, F.lit(v)) if out is None else out.when(code == k, F.lit(v))
    return out


def shift_valid(c: Column | str, codes: tuple[str, ...] = ("1", "2")) -> Column:
    """Boolean form of C4 (null cell -> false)."""
    return F.coalesce(shift_code(c).isin(*codes), F.lit(False))


def hour_value(c: Column | str) -> Column:
    """Numeric hour or null (``"06:00"`` -> null, ``"21.0"`` -> 21.0)."""
    return number_or_null(c)


def oee_product(availability: Column | str, performance: Column | str, quality: Column | str,
                decimals: int | None = None) -> Column:
    """OEE = A x P x Q; optionally rounded half-even like pandas/numpy."""
    if decimals is None:
        return _col(availability) * _col(performance) * _col(quality)
    # Half-even on the decimal value of the product where the inputs have at most six decimals, up
    # to the last bits of a division by 100 (ties are then decided on decimal digits); any other
    # value rounds as a double.
    factors = [_col(c) for c in (availability, performance, quality)]
    short = [f.try_cast("decimal(12,6)") for f in factors]
    exact = F.lit(True)
    for f, d in zip(factors, short):
        exact = exact & (F.abs(d.cast("double") - f) < 1e-12)
    product = short[0] * short[1] * short[2]
    plain = factors[0] * factors[1] * factors[2]
    return F.when(F.coalesce(exact, F.lit(False)), F.bround(product, decimals).cast("double")).otherwise(F.bround(plain, decimals))


def zero_as_null(c: Column | str) -> Column:
    """0 -> null."""
    return F.nullif(_col(c), F.lit(0.0))


def weekday_index(d: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(d))


def day_month_label(d: Column | str) -> Column:
    return F.date_format(_col(d), "dd/MM")


def weekday_name(d: Column | str) -> Column:
    return F.date_format(_col(d), "EEEE")


def weekday_name_pt(d: Column | str) -> Column:
    """Portuguese weekday name by lookup; unknown names come back unchanged."""
    name = weekday_name(d)
    lookup = F.create_map(*[F.lit(x) for kv in WEEKDAY_PT.items() for x in kv])
    return F.coalesce(F.element_at(lookup, name), name)


def valid_machine(c: Column | str, mark: str = SUBTOTAL_MARK) -> Column:
    """F1 machine test: present and not a subtotal row (case-sensitive)."""
    m = _col(c)
    return m.isNotNull() & ~F.coalesce(m.cast("string").contains(mark), F.lit(False))
