"""The scalar scores as SQL functions, for queries that are written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import fixed_values as fv


def _cases(value: str, bands, index: int, otherwise: str) -> str:
    rows = sorted(bands, key=lambda b: -b[0])
    return "CASE " + " ".join(f"WHEN {value} >= {row[0]!r}D THEN '{row[index]}'" for row in rows) + f" ELSE '{otherwise}' END"


def definitions() -> dict[str, str]:
    """name(arguments) RETURNS type -> expression."""
    w = fv.ENTITY_WEIGHTS
    p, z2 = "(CAST(k AS DOUBLE) / n)", repr(1.96 ** 2) + "D"
    centre = f"({p} + {z2} / (2 * n)) / (1D + {z2} / n)"
    half = f"1.96D * sqrt({p} * (1D - {p}) / n + {z2} / (4D * n * n)) / (1D + {z2} / n)"
    return {
        "sensitivity_score(high BIGINT, medium BIGINT, low BIGINT) RETURNS INT":
            f"CAST(least({w['HIGH']} * high + {w['MEDIUM']} * medium + {w['LOW']} * low, 100) AS INT)",
        "sensitivity_category(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 70 THEN 'HIGH-RISK' WHEN score >= 20 THEN 'SENSITIVE' ELSE 'SAFE' END",
        "category_action(category STRING) RETURNS STRING": "CASE category WHEN 'HIGH-RISK' THEN 'BLOCK' WHEN 'SENSITIVE' THEN 'ALERT' ELSE 'PERMIT' END",
        f"risk_value(s DOUBLE, a DOUBLE, beta DOUBLE DEFAULT {fv.SBRS_BETA!r}D) RETURNS DOUBLE":
            "CASE WHEN s IS NOT NULL AND a IS NOT NULL THEN least(100D, greatest(0D, s)) * (1D + beta * least(1D, greatest(0D, a))) / 100D END",
        "risk_category(value DOUBLE) RETURNS STRING": _cases("value", fv.SBRS_BANDS, 1, "SAFE"),
        "risk_action(value DOUBLE) RETURNS STRING": _cases("value", fv.SBRS_BANDS, 2, "PERMIT"),
        f"ewma_step(x DOUBLE, previous DOUBLE, lambda DOUBLE DEFAULT {fv.EWMA_LAMBDA!r}D) RETURNS DOUBLE": "lambda * x + (1D - lambda) * previous",
        "ewma_deviation(x DOUBLE, previous DOUBLE) RETURNS DOUBLE": f"(x - previous) / greatest(previous, {fv.EWMA_STATE_FLOOR!r}D)",
        "activity_ratio(rate DOUBLE, baseline DOUBLE) RETURNS DOUBLE":
            f"greatest(0D, least({float(fv.MAX_ACTIVITY_RATIO)!r}D, CASE WHEN rate <> 0 AND baseline <> 0 THEN rate / baseline ELSE 1D END))",
        "wilson_low(k BIGINT, n BIGINT) RETURNS DOUBLE": f"CASE WHEN n = 0 THEN double('NaN') ELSE greatest(0D, {centre} - {half}) END",
        "wilson_high(k BIGINT, n BIGINT) RETURNS DOUBLE": f"CASE WHEN n = 0 THEN double('NaN') ELSE least(1D, {centre} + {half}) END",
        "half_even(value DOUBLE, digits INT) RETURNS DOUBLE": "rint(value * pow(10D, digits)) / pow(10D, digits)",
        "wilson_interval(k BIGINT, n BIGINT) RETURNS TABLE(low DOUBLE, high DOUBLE)": "SELECT wilson_low(k, n), wilson_high(k, n)",
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session; their names.  They are expressions, which Catalyst inlines."""
    made = definitions()
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in made]
