"""Column functions: decay, clipping, certainty-guarded percentages, counter-based random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def decay(age_days: Column, half_life: float | Column) -> Column:
    """0.5 ** (age / half-life), 1 for the future."""
    half = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.pow(F.lit(0.5), F.greatest(age_days.cast("double"), F.lit(0.0)) / half)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def time_multiplier(days: Column | int, per_30_days: float) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return 1 + F.lit(per_30_days) * F.greatest(days.cast("double"), F.lit(0.0)) / 30


def pct_guard(p: Column) -> Column:
    """A probability as whole percent; only exact 0 and 1 may print as 0% and 100%."""
    whole = F.floor(p * 100 + 0.5).cast("int")
    return (
        F.when(p <= 0, "0%").when(p >= 1, "100%").when(whole >= 100, ">99%").when(whole <= 0, "<1%")
        .otherwise(F.concat(whole.cast("string"), F.lit("%")))
    )


#: The lower ends of the probability bands.
BANDS = (0.95, 0.8, 0.6, 0.55, 0.45, 0.35, 0.2, 0.05)
BAND_WORDS = ("almost certain", "very likely", "likely", "leaning", "even", "leaning against", "unlikely", "very unlikely", "remote")


def probability_word(p: Column) -> Column:
    out = F.lit(BAND_WORDS[-1])
    for band, word in reversed(list(zip(BANDS, BAND_WORDS))):
        out = F.when(p >= band, F.lit(word)).otherwise(out)
    return out


def signed(x: Column, digits: int = 1) -> Column:
    """A number with an explicit sign (U+2212 for minus), a trailing ``.0`` left out."""
    body = F.regexp_replace(F.format_string(f"%.{digits}f", F.abs(x)), r"\.0$", "")
    return F.concat(F.when(x < 0, "−").when(x > 0, "+").otherwise(""), body)


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def long_date(day: Column, months: list[str] | None = None) -> Column:
    """Day, month name and year; ``months`` in any language, for the JVM's locale must not decide."""
    names = F.array(*[F.lit(m) for m in (months or MONTHS)])
    return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))


def short_date(day: Column, months: list[str] | None = None) -> Column:
    """Day and month name."""
    names = F.array(*[F.lit(m) for m in (months or MONTHS)])
    return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(names, F.month(day)))


def days_word(n: Column, one: str = "day", many: str = "days") -> Column:
    """``1 day``, ``3 days``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; else each use repeats it, and nested uses multiply."""
    return F.element_at(F.transform(F.array(value), body), 1)


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit values, without overflow of a BIGINT."""
    high = F.shiftright(a, 16) * b
    return (high.bitwiseAND(F.lit(65535)) * 65536 + a.bitwiseAND(F.lit(65535)) * b).bitwiseAND(F.lit(MASK))


def uniform(seed: Column | int, n: Column) -> Column:
    """The ``n``-th (from 0) output in [0, 1) of the 32-bit generator that starts at ``seed``.

    The generator's state is a counter, so each output is a function of its place and rows need no order.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed).cast("long")
    state = (seed + (n + 1).bitwiseAND(F.lit(MASK)) * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(MASK))
    first = lambda s: let(s.bitwiseXOR(F.shiftright(s, 15)), lambda x: let(s.bitwiseOR(F.lit(1)), lambda y: imul(x, y)))
    again = lambda t: let(t.bitwiseXOR(F.shiftright(t, 7)), lambda x: let(t.bitwiseOR(F.lit(61)), lambda y: imul(x, y)))
    second = lambda t: t.bitwiseXOR((t + again(t)).bitwiseAND(F.lit(MASK)))
    last = lambda u: u.bitwiseXOR(F.shiftright(u, 14))
    return let(let(let(state, first), second), last) / F.lit(4294967296.0)


def seed_from_string(text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    h = 2166136261
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & MASK
    return h


def seed_of(text: Column) -> Column:
    """``seed_from_string`` of a column."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1)
    codes = F.transform(units, lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: imul(h.bitwiseXOR(c), F.lit(16777619).cast("long")))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))
