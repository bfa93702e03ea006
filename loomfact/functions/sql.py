"""SQL functions of the library, for queries written as text; arguments may be named (f(x => 1))."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .degrees import SPREAD

#: name(arguments) returns expression; the optimizer inlines them.
FUNCTIONS = {
    "similar_numbers(a DOUBLE, b DOUBLE)": ("DOUBLE", "1 / (1 + abs(a - b))"),
    "similar_degrees(a DOUBLE, b DOUBLE)": ("DOUBLE", "1 - abs(a - b)"),
    "normalised(t STRING)": ("STRING", "trim(regexp_replace(lower(t), '[^a-z0-9]+', ' '))"),
    "sigmoid(x DOUBLE)": ("DOUBLE", "1 / (1 + exp(-x))"),
    "relu(x DOUBLE)": ("DOUBLE", "greatest(x, 0D)"),
    "membership(v DOUBLE, peak DOUBLE, fades_in DOUBLE, fades_out DOUBLE)": (
        "DOUBLE",
        f"""CASE WHEN NOT (fades_in <= peak AND peak <= fades_out) THEN CAST(raise_error('a profile needs fades_in <= peak <= fades_out') AS DOUBLE)
            WHEN fades_in = peak AND peak = fades_out THEN CAST(v = peak AS DOUBLE)
            WHEN (v <= peak AND fades_in < peak) OR peak = fades_out THEN exp(-0.5D * pow((v - peak) * {SPREAD!r}D / nullif(peak - fades_in, 0D), 2D))
            ELSE exp(-0.5D * pow((v - peak) * {SPREAD!r}D / nullif(fades_out - peak, 0D), 2D)) END""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session; their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
