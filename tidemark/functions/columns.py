"""Functions from columns to columns. Unknown is null throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rate-ratio thresholds of the patterns, days of a month, z of a 95 % interval.
THRESHOLDS = {"C1": 1.69, "C2": 1.83, "C3": 1.62}
DAYS_PER_MONTH = 30
Z95 = 1.959963984540054


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def backward_day(day, length) -> Column:
    """Day counted from the end of the cycle; the last day is -1."""
    return col(day) - (col(length) + 1)


def _menses(day: Column, back: Column) -> Column:
    return (day <= 3) | (back >= -3)


def phase_strict(day, length) -> Column:
    """M, O, F or L by fixed days; null outside 1..length. Menses come first, then fixed days."""
    d, b = col(day), backward_day(day, length)
    inside = (d >= 1) & (d <= col(length))
    label = F.when(_menses(d, b), "M").when(d.between(4, 9), "F").when((d >= 10) & (b <= -13), "O").when(b.between(-12, -4), "L")
    return F.when(inside, label)


def phase_modified_short(day, length) -> Column:
    """As :func:`phase_strict` from 23 days on; shorter cycles get O at -19..-13, L at -12..-4, else F."""
    d, b = col(day), backward_day(day, length)
    inside = (d >= 1) & (d <= col(length))
    short = F.when(_menses(d, b), "M").when(b.between(-19, -13), "O").when(b.between(-12, -4), "L").otherwise("F")
    return F.when(col(length) >= 23, phase_strict(day, length)).when(inside, short)


def phase_luteal_anchored(day, length) -> Column:
    """O at -16..-13 and L at -12..-4 whatever the length."""
    d, b = col(day), backward_day(day, length)
    inside = (d >= 1) & (d <= col(length))
    return F.when(inside, F.when(_menses(d, b), "M").when(b.between(-12, -4), "L").when(b.between(-16, -13), "O").otherwise("F"))


def phase_reddy(day, length) -> Column:
    """P (the M days), F 4..9, O 10..16, else L."""
    d, b = col(day), backward_day(day, length)
    inside = (d >= 1) & (d <= col(length))
    return F.when(inside, F.when(_menses(d, b), "P").when(d.between(4, 9), "F").when(d.between(10, 16), "O").otherwise("L"))


PHASES = {"strict_herzog": phase_strict, "modified_short_cycle": phase_modified_short, "luteal_anchored_ovulatory": phase_luteal_anchored}


def adsf_ratio(count, days, other_count, other_days) -> Column:
    """Struct (ratio, numerator, comparator, reason) of two event rates.

    A positive rate over zero is +infinity; zero over zero and phases without days are undefined.
    """
    c, d, oc, od = map(col, (count, days, other_count, other_days))
    both = (d > 0) & (od > 0)
    top, below = F.when(both, F.try_divide(c.cast("double"), d)), F.when(both, F.try_divide(oc.cast("double"), od))
    ratio = F.when(below > 0, F.try_divide(top, below)).when((below == 0) & (top > 0), F.lit(float("inf")))
    reason = F.when(d <= 0, "missing_numerator_phase").when(od <= 0, "missing_comparator_phase").when((top == 0) & (below == 0), "undefined_zero_over_zero")
    return F.struct(ratio.alias("ratio"), top.alias("numerator"), below.alias("comparator"), reason.alias("reason"))


def ratio_positive(ratio, threshold) -> Column:
    """Whether a ratio reaches the threshold; null if it is undefined."""
    r = col(ratio)
    return F.when(r.isNotNull() & ~F.isnan(r), r >= threshold)


def any_known(*labels) -> Column:
    """True if one is true, else false if one is false, else null (not SQL's OR)."""
    return F.greatest(*map(col, labels))


def first_reason(*reasons) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(r), F.lit("")) for r in reasons])


def month_denominator(days, per_month: int = DAYS_PER_MONTH) -> Column:
    """Months of a number of days; null without days."""
    return F.when(col(days) > 0, col(days) / F.lit(float(per_month)))


def pattern_category(c1, c2, c3) -> Column:
    """The mutually exclusive category of three pattern labels; null if none is known."""
    c1, c2, c3 = map(col, (c1, c2, c3))
    yes = lambda c: c.eqNullSafe(F.lit(True))
    known = F.coalesce(c1, c2, c3).isNotNull()
    return F.when(
        known,
        F.when(yes(c3) & (yes(c1) | yes(c2)), "C3 plus C1/C2").when(yes(c3), "C3 only").when(yes(c1) & yes(c2), "C1+C2").when(yes(c1), "C1 only").when(yes(c2), "C2 only").otherwise("none"),
    )


# Names of the strata.
SEIZURE_FREQUENCY = ["<1 seizure-day/month", "1 to <4 seizure-days/month", "4 to <10 seizure-days/month", ">=10 seizure-days/month"]
CYCLE_REGULARITY = ["SD cycle length <2 days", "SD cycle length 2 to <4 days", "SD cycle length >=4 days"]


def _banded(x: Column, cuts: list[float], names: list[str]) -> Column:
    out = F.when(x.isNull() | F.isnan(x), "unknown")
    for cut, name in zip(cuts, names, strict=False):
        out = out.when(x < cut, name)
    return out.otherwise(names[-1])


def seizure_frequency_stratum(per_month) -> Column:
    return _banded(col(per_month), [1, 4, 10], SEIZURE_FREQUENCY)


def cycle_regularity_stratum(sd) -> Column:
    return _banded(col(sd), [2, 4], CYCLE_REGULARITY)


def holm_two(p1, p2) -> tuple[Column, Column]:
    """Step-down adjusted values of two tests."""
    a, b = col(p1), col(p2)
    low = F.least(F.lit(1.0), F.least(a, b) * 2)
    high = F.greatest(low, F.greatest(a, b))
    return F.when(a <= b, low).otherwise(high), F.when(a <= b, high).otherwise(low)


def normal_cdf(z) -> Column:
    """Standard normal distribution function; absolute error below 1e-7 (rational approximation of erfc)."""
    # Coefficients of the published five-term approximation (Abramowitz and Stegun 26.2.17).
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.abs(col(z))
    t = 1 / (1 + p * x)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly
    return F.when(col(z) >= 0, 1 - tail).otherwise(tail)


def wilson(successes, total) -> tuple[Column, Column]:
    """Lower and upper bound of the 95 % Wilson interval in [0, 1]; null without trials."""
    k, n = col(successes).cast("double"), col(total).cast("double")
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(Z95**2), n)
    center = F.try_divide(p + F.try_divide(F.lit(Z95**2), 2 * n), scale)
    half = F.try_divide(Z95 * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(Z95**2), 4 * n), n)), scale)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), center - half)), F.when(ok, F.least(F.lit(1.0), center + half))


def tri_bool(label) -> Column:
    """True, false or null from text, number or boolean."""
    return F.expr("null").cast("boolean") if label is None else F.try_to_boolean(col(label)) if hasattr(F, "try_to_boolean") else col(label).try_cast("boolean")


def stable_hash(seed: int, *parts) -> Column:
    """A number below 2**32 from the sha256 of the seed and the parts, the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def finite_or_null(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rate_ci_text(rate, low, high) -> Column:
    """``12.3% (10.0, 15.0)``, ``NA`` without a rate."""
    part = lambda x: F.bround(F.round(col(x) * 100, 6).cast("decimal(20,6)"), 1).cast("string")
    return F.when(col(rate).isNotNull(), F.concat(part(rate), F.lit("% ("), part(low), F.lit(", "), part(high), F.lit(")"))).otherwise("NA")


def window_label(kind, value) -> Column:
    """``1 month``, ``3 months``, ``6 cycles``; a full diary counts as 36 months, other kinds are named as they are."""
    n = col(value).try_cast("double").cast("int")
    many = lambda unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    return F.when(col(kind) == "full", "36 months").when(col(kind) == "calendar", many("month")).when(col(kind) == "cycle", many("cycle")).otherwise(F.concat(col(kind), F.lit(" "), col(value)))


def window_order(kind, value) -> Column:
    """Sort key: calendar windows by months, the full diary, then cycle windows."""
    n = F.expr("try_cast({} as int)".format(value if isinstance(value, str) else "window_value"))
    return F.when(col(kind) == "calendar", n).when(col(kind) == "full", 1000).otherwise(2000 + n)


# Half-open age bands in years (lower bounds); the last band is the default.
AGE_BANDS = [("<20", 0.0), ("20-24", 20.0), ("25-29", 25.0), ("30-34", 30.0), ("35-39", 35.0), ("40-44", 40.0), ("45-49", 45.0), ("50+", 50.0)]


def age_band(age) -> Column:
    out = F.lit(AGE_BANDS[-1][0])
    for (name, _), (_, upper) in reversed(list(zip(AGE_BANDS, AGE_BANDS[1:], strict=False))):
        out = F.when(col(age) < upper, name).otherwise(out)
    return out


# pmol/L of estradiol in 1 pg/mL, nmol/L of progesterone in 1 ng/mL.
PMOL_L_PER_PG_ML, NMOL_L_PER_NG_ML = 3.671, 3.18


def estradiol_pg_ml(pmol_l) -> Column:
    """pmol/L to pg/mL."""
    return col(pmol_l) / F.lit(PMOL_L_PER_PG_ML)


def progesterone_ng_ml(nmol_l) -> Column:
    """nmol/L to ng/mL."""
    return col(nmol_l) / F.lit(NMOL_L_PER_NG_ML)
