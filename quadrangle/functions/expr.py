"""Scalar column expressions (X1-X11, F11).  All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(c) -> Column:
    """Two decimals, half toward +inf on the binary value
    (``Math.round(x*100)/100``).  ``F.round`` rounds half away from zero on
    the decimal value and would turn 1.005 into 1.01."""
    return F.floor(col(c) * 100 + 0.5) / 100


def hundredths(c) -> Column:
    """The integer k with round2(x) == k/100 (exact, for order-free sums)."""
    return F.floor(col(c) * 100 + 0.5).cast("bigint")


def safe_ratio(num, den, zero=0.0) -> Column:
    """Ratio with a zero (or NULL) denominator giving ``zero``."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(zero))


def nz(c, zero=0) -> Column:
    """T4: NULL counts as zero in weights and credits."""
    return F.coalesce(col(c), F.lit(zero))


def ceil_div(total, limit) -> Column:
    """Number of pages."""
    return F.ceil(col(total) / F.lit(limit)).cast("bigint")


def month_of(c) -> Column:
    """``yyyy-MM`` of a date, NULL when the value is not a date.
    Text input is parsed with the explicit format, so malformed text gives
    NULL rather than an error."""
    c = col(c)
    return F.date_format(F.try_to_date(c.cast("string"), "yyyy-MM-dd"), "yyyy-MM")


# Grade bands (lower bound, label), highest first.
GRADE_BANDS = [(16, "Très bien"), (14, "Bien"), (12, "Assez bien"), (10, "Passable")]
GRADE_BAND_ELSE = "Insuffisant"


def grade_band(c) -> Column:
    """CASE band of a grade."""
    c = col(c)
    out = None
    for lo, label in GRADE_BANDS:
        out = F.when(c >= lo, F.lit(label)) if out is None else out.when(c >= lo, F.lit(label))
    return out.otherwise(F.lit(GRADE_BAND_ELSE))


# Document number prefixes.
DOC_PREFIXES = {"bill": "FAC", "payment": "PAY", "expense": "EXP",
                "teaching_staff": "ENS", "admin_staff": "ADM"}


def doc_number(kind: str, ts, seq=None) -> Column:
    """``PREFIX-YYYY-NNNNNN``.  One record at a time the tail is the last
    six digits of the epoch milliseconds; in bulk that would repeat every
    1,000 s, so a sequence number replaces it when ``seq`` is given: padded
    with zeros to six digits, longer ones whole."""
    ts = col(ts)
    prefix = DOC_PREFIXES[kind]
    if seq is None:
        tail = F.substring(F.unix_millis(ts).cast("string"), -6, 6)
    else:
        digits = col(seq).cast("string")
        tail = F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), "0")
    return F.concat(F.lit(prefix + "-"), F.year(ts).cast("string"), F.lit("-"), tail)


def doc_tail(c, kind: str, ts) -> Column:
    """The number at the end of a document number of this kind and year, NULL
    for any other text."""
    c = col(c)
    head = F.concat(F.lit(f"{DOC_PREFIXES[kind]}-"), F.year(col(ts)).cast("string"), F.lit("-"))
    return F.when(c.startswith(head), F.substring_index(c, "-", -1).try_cast("bigint"))


def parse_bool(c) -> Column:
    """Text or boolean to boolean; NULL when not a boolean word."""
    c = col(c)
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s.isin("true", "1"), F.lit(True))
            .when(s.isin("false", "0"), F.lit(False)))


def param_long(v) -> Column:
    """A text parameter compared with an integer key: ``try_cast``
    so that ``'abc'`` matches nothing instead of raising."""
    return F.lit(None if v is None else str(v)).try_cast("bigint")


def time_minutes(c) -> Column:
    """Minutes of day of an ``H:MM`` / ``HH:MM`` text (NULL if malformed)."""
    c = col(c)
    ok = c.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$")
    parts = F.split(c, ":")
    mins = parts.getItem(0).try_cast("int") * 60 + parts.getItem(1).try_cast("int")
    return F.when(ok, mins)


def conflict_cond(s_start, s_end, c_start, c_end) -> Column:
    """The three-arm test of a stored session (s) against a
    candidate (c), kept literally: it equals interval overlap only for
    well-formed pairs, and flags zero-length sessions."""
    s_start, s_end, c_start, c_end = map(col, (s_start, s_end, c_start, c_end))
    return (((s_start <= c_start) & (s_end > c_start))
            | ((s_start < c_end) & (s_end >= c_end))
            | ((s_start >= c_start) & (s_end <= c_end)))


def like_term(term: str) -> str:
    """``%term%`` with backslashes doubled (Spark's LIKE escape char)."""
    return "%" + term.replace("\\", "\\\\") + "%"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c) -> Column:
    """Lower-casing of A-Z only (SQLite's LIKE folding)."""
    return F.translate(col(c), _UPPER, _UPPER.lower())


# The week, Monday first.
WEEK = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]


def weekday_rank(c) -> Column:
    """T14 option: position of a French day name in the week (1 = Lundi,
    0 when not a day name), to sort by calendar instead of alphabetically."""
    return F.array_position(F.array(*[F.lit(d) for d in WEEK]), col(c))
