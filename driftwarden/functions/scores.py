"""Scalar scoring expressions. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def clamp(value, lo: float, hi: float) -> Column:
    """numpy-style clip; a null stays null."""
    value = _c(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), value)))


def round_even(value, digits: int) -> Column:
    """numpy-style rounding: scale, round half to even, scale back."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(value).cast("double") * scale) / scale


def ratio(num, den) -> Column:
    """num / den, zero when the denominator is zero."""
    num, den = _c(num).cast("double"), _c(den).cast("double")
    return F.when(den != 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def lookup(key, table: dict, default=None) -> Column:
    """Small constant map as an expression; unknown or null keys give the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.coalesce(_c(key), F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def sensitivity(high, medium, low) -> Column:
    w = fv.ENTITY_WEIGHTS
    total = w["HIGH"] * _c(high) + w["MEDIUM"] * _c(medium) + w["LOW"] * _c(low)
    return F.least(total, F.lit(100)).cast("int")


def risk_category(score) -> Column:
    score = _c(score)
    return (F.when(score >= 70, "HIGH-RISK").when(score >= 20, "SENSITIVE").otherwise("SAFE"))


def action_for(category) -> Column:
    return lookup(category, {"HIGH-RISK": "BLOCK", "SENSITIVE": "ALERT"}, "PERMIT")


def sbrs(s, a, beta=fv.SBRS_BETA) -> Column:
    s, a = clamp(_c(s).cast("double"), 0.0, 100.0), clamp(_c(a), 0.0, 1.0)
    return s * (F.lit(1.0) + _c(beta) * a) / F.lit(100.0)


def band_field(value, bands, index: int) -> Column:
    """Category (index 1) or action (index 2); highest cut first, tested with >=."""
    value, expr = _c(value), None
    for row in sorted(bands, key=lambda b: -b[0]):
        cond = value >= F.lit(row[0])
        expr = F.when(cond, row[index]) if expr is None else expr.when(cond, row[index])
    return expr.otherwise(("SAFE", "PERMIT")[index - 1])


def band_category(value, bands=fv.SBRS_BANDS) -> Column:
    return band_field(value, bands, 1)


def band_action(value, bands=fv.SBRS_BANDS) -> Column:
    return band_field(value, bands, 2)


def serving_sbrs(score, a, beta=fv.SBRS_BETA) -> Column:
    """Nested result of the serving path: S truncated to an integer, output rounded to 4 dp,
    bands tested on the unrounded value."""
    s = clamp(_c(score).cast("int"), 0, 100).cast("int")
    a = clamp(_c(a).cast("double"), 0.0, 1.0)
    value = s * (F.lit(1.0) + _c(beta) * a) / F.lit(100.0)
    return F.struct(
        s.alias("sensitivity_score"), round_even(a, 4).alias("hybrid_anomaly_score"),
        _c(beta).cast("double").alias("beta"), round_even(value, 4).alias("sbrs_value"),
        band_category(value).alias("sbrs_category"), band_action(value).alias("enforcement_action"),
        F.lit("SBRS = S * (1 + beta * A_hybrid) / 100").alias("formula"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, l1, p2, l2 = (F.radians(_c(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.lit(fv.EARTH_KM) * F.lit(2.0) * F.asin(F.sqrt(h))


def geo_index(lat1, lon1, lat2, lon2) -> Column:
    """Distance over 5000 km capped at 1; one side unknown -> 0; both unknown -> 0.5."""
    have1, have2 = _c(lat1).isNotNull(), _c(lat2).isNotNull()
    return (F.when(have1 & have2,
                   F.least(haversine_km(lat1, lon1, lat2, lon2) / F.lit(fv.GEO_NORM_KM), F.lit(1.0)))
            .when(have1 | have2, 0.0).otherwise(fv.UNKNOWN_GEO_INDEX))


def city_key(geo) -> Column:
    return F.lower(F.trim(F.split_part(_c(geo), F.lit(","), F.lit(1))))


def city_coord(geo, axis: int) -> Column:
    return lookup(city_key(geo), {name: xy[axis] for name, xy in fv.CITIES.items()})


def file_class_of_sensitivity(s) -> Column:
    s = _c(s)
    expr = F.when(s.isNull(), fv.UNKNOWN_FILE_CLASS)
    for cut, ordinal in fv.FILE_CLASS_CUTS:
        expr = expr.when(s >= cut, ordinal)
    return expr.otherwise(0.0)


def endpoint_of_action(action) -> Column:
    return lookup(F.upper(_c(action)), fv.API_ACTION_ORDINAL, 0.0)


def activity_ratio(rate, baseline) -> Column:
    """rate / baseline clipped to 0..10; 1.0 when either is missing or zero."""
    rate, baseline = _c(rate).cast("double"), _c(baseline).cast("double")
    usable = rate.isNotNull() & (rate != 0) & baseline.isNotNull() & (baseline != 0)
    return clamp(F.when(usable, F.try_divide(rate, baseline)).otherwise(1.0), 0.0,
                 fv.MAX_ACTIVITY_RATIO)


def scope_delta(file_department, department) -> Column:
    same = _c(file_department).isNull() | _c(file_department).eqNullSafe(_c(department))
    return F.when(same, 0.0).otherwise(fv.SCOPE_MISMATCH_DELTA)


def positive_or_null(value) -> Column:
    """value when finite and > 0, else null."""
    value = _c(value).cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf")))
    return F.when(ok, value)


def zscore(value, mu, sd, clip: float = fv.Z_CLIP) -> Column:
    return clamp((_c(value) - _c(mu)) / _c(sd), -clip, clip)


def calibrate(raw, lo, hi) -> Column:
    return clamp((_c(raw) - _c(lo)) / (_c(hi) - _c(lo)), 0.0, 1.0)


def fuse(a, b, alpha) -> Column:
    alpha = _c(alpha)
    return alpha * _c(a) + (F.lit(1.0) - alpha) * _c(b)


def ewma_step(x, previous, lam: float = fv.EWMA_LAMBDA) -> Column:
    return F.lit(lam) * _c(x) + F.lit(1.0 - lam) * _c(previous)


def ewma_deviation(x, previous) -> Column:
    return (_c(x) - _c(previous)) / F.greatest(_c(previous), F.lit(fv.EWMA_STATE_FLOOR))


def wilson_bounds(k, n, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper 95 % bound, clipped to 0..1, NaN for n = 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p, z2 = F.try_divide(k, n), F.lit(z * z)
    d = F.lit(1.0) + F.try_divide(z2, n)
    centre = (p + F.try_divide(z2, n * 2)) / d
    half = F.lit(z) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(z2, n * n * 4)) / d
    nan = F.lit(float("nan"))
    return (F.when(n == 0, nan).otherwise(F.greatest(F.lit(0.0), centre - half)),
            F.when(n == 0, nan).otherwise(F.least(F.lit(1.0), centre + half)))


def precision_recall(tp, fp, fn) -> tuple[Column, Column, Column]:
    tp, fp, fn = _c(tp), _c(fp), _c(fn)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(F.lit(2.0) * p * r, p + r)


def grid_rank(value, per_unit: int, first: int, last: int, strict: bool = False) -> Column:
    """How many grid points i / per_unit (i = first..last) lie at or (strict) below value.

    Constant time per row: an estimate from the floor is corrected by exact comparison with
    the neighbouring grid points, so no float binning enters the result.
    """
    value = _c(value).cast("double")
    near = clamp(F.floor(clamp(value, (first - 2) / per_unit, (last + 2) / per_unit)
                         * F.lit(float(per_unit))), first - 2, last + 2).cast("int")

    def reached(i):
        point = i.cast("double") / F.lit(float(per_unit))
        return (point < value) if strict else (point <= value)

    top = (F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1))
    return F.when(value.isNotNull() & ~F.isnan(value),
                  F.greatest(F.lit(0), F.least(F.lit(last - first + 1), top - F.lit(first - 1)))
                  ).otherwise(F.lit(0)).cast("int")
