"""Pond sizing, runoff and display scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNOFF_COEFFICIENT = 0.18
POND_DEPTH_M = 3.0
STORAGE_EFFICIENCY = 0.70
RATIO_WARNING = 50.0
SELF_OVERLAP_WARNING = 50.0
WATER_LIMIT = 0.30
LEAST_COMPACTNESS = 0.5

# Runoff coefficients by catchment class (A to E) and season (I to III).
RUNOFF_BY_CLASS = {
    "A": (0.07, 0.10, 0.15),
    "B": (0.12, 0.15, 0.18),
    "C": (0.16, 0.20, 0.32),
    "D": (0.28, 0.35, 0.60),
    "E": (0.36, 0.45, 0.81),
}

# Colour stops of the elevation ramp (position, red, green, blue).
ELEVATION_STOPS = ((0.0, 33, 102, 172), (0.25, 103, 169, 207), (0.5, 253, 219, 199), (0.75, 239, 138, 98), (1.0, 178, 24, 43))
# Colours of the ranks, the last for all further ones.
RANK_COLORS = ("#00e676", "#66dd55", "#a8d63a", "#d4c22c", "#f0a020")


def runoff_m3(area_m2: Column, rain_mm, coefficient=RUNOFF_COEFFICIENT) -> Column:
    rain = rain_mm if isinstance(rain_mm, Column) else F.lit(float(rain_mm))
    return F.when((area_m2 > 0) & (rain > 0), area_m2 * (rain / 1000.0) * coefficient).otherwise(0.0)


def capacity_m3(area_m2: Column, depth=POND_DEPTH_M, efficiency: float = STORAGE_EFFICIENCY) -> Column:
    deep = depth if isinstance(depth, Column) else F.lit(float(depth))
    return F.when((area_m2 > 0) & (deep > 0), area_m2 * deep * efficiency).otherwise(0.0)


def capture_fraction(capacity: Column, runoff: Column) -> Column:
    return F.when(runoff > 0, F.least(F.lit(1.0), capacity / F.when(runoff > 0, runoff))).otherwise(0.0)


def expected_m3(capacity: Column, runoff: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(capacity, runoff))


def fill_ratio(capacity: Column, runoff: Column) -> Column:
    return F.when(capacity > 0, runoff / F.when(capacity > 0, capacity)).otherwise(0.0)


def storage_m3(area_m2: Column, mean_depth: Column) -> Column:
    return area_m2 * mean_depth


def compactness(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2 of one polygon; null for no perimeter."""
    return 4.0 * 3.141592653589793 * area / F.when(perimeter > 0, perimeter * perimeter)


def runoff_table(spark: SparkSession) -> DataFrame:
    """class, season, coefficient: fifteen rows, fit for a broadcast."""
    seasons = ("I", "II", "III")
    return spark.createDataFrame([(k, s, v) for k, row in RUNOFF_BY_CLASS.items() for s, v in zip(seasons, row, strict=True)], "class string, season string, coefficient double")


def provenance() -> Column:
    """Where the constants come from, as a literal struct."""
    notes = {
        "runoff_coefficient": f"{RUNOFF_COEFFICIENT}: table of runoff coefficients, class B, season III",
        "pond_depth_m": f"{POND_DEPTH_M}: usual depth of a dug pond",
        "storage_efficiency": f"{STORAGE_EFFICIENCY}: share of the prism that sloping sides leave",
    }
    return F.struct(*[F.lit(v).alias(k) for k, v in notes.items()])


def catchment_ratio(catchment_m2: Column, pond_m2: Column) -> Column:
    return F.when(pond_m2 > 0, catchment_m2 / F.when(pond_m2 > 0, pond_m2)).otherwise(0.0)


def plan_warnings(ratio: Column, fill: Column) -> Column:
    """Warnings of a pond plan, in order, without nulls."""
    return F.array_compact(
        F.array(
            F.when(ratio > RATIO_WARNING, F.format_string("catchment is %.1f times the pond", ratio)),
            F.when(fill < 1, F.format_string("one storm fills %.0f%% of the pond", fill * 100.0)).when(fill > 5, F.format_string("one storm brings %.1f times the capacity", fill)),
        )
    )


def fill_status(fill: Column) -> Column:
    return F.when(fill >= 1, "good").when(fill >= 0.5, "warn").otherwise("bad")


def overlap_warning(percent: Column) -> Column:
    return F.when(percent < SELF_OVERLAP_WARNING, F.format_string("only %.0f%% of the pond drains to its own outlet", percent))


def design_storm(available: Column, value: Column) -> Column:
    return F.when(available, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def depth_threshold(given: Column, interval: Column) -> Column:
    return F.coalesce(given, interval, F.lit(1.0))


def buffer_pixels(metres: float, metres_per_pixel: Column) -> Column:
    """Half-even rounding, one at least."""
    return F.greatest(F.lit(1), F.rint(metres / metres_per_pixel).cast("int"))


def cache_key(kind: str, *parts: Column, places: int = 5) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.format_string(f"%.{places}f", p) for p in parts])


def lakh(value: Column) -> Column:
    """Hundreds of thousands, where the value reaches one; else null."""
    return F.when(value >= 100_000, F.format_string("%.2f lakh", value / 100_000.0))


def format_m3(value: Column) -> Column:
    return F.concat(F.format_number(F.round(value), 0), F.lit(" m³"))


def format_km2(hectares: Column) -> Column:
    """Square kilometres, one place from a square kilometre on, else two."""
    return F.when(hectares >= 100, F.format_string("%.1f km²", hectares / 100.0)).otherwise(F.format_string("%.2f km²", hectares / 100.0))


def format_ha(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f ha", value)


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def format_pct(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100.0)


def normalised_elevation(value: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (value - low) / F.when(high > low, high - low)).otherwise(0.5)


def elevation_color(t: Column) -> Column:
    """rgb(r, g, b) on a piecewise-linear ramp, clamped."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    channels = []
    for k in (1, 2, 3):
        value = F.lit(float(ELEVATION_STOPS[-1][k]))
        for low, high in reversed(list(zip(ELEVATION_STOPS, ELEVATION_STOPS[1:], strict=False))):
            value = F.when(at <= high[0], low[k] + (at - low[0]) / (high[0] - low[0]) * (high[k] - low[k])).otherwise(value)
        channels.append(F.floor(value + 0.5).cast("int"))
    return F.format_string("rgb(%d, %d, %d)", *channels)


def rank_color(rank: Column, colors=RANK_COLORS) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in colors]), F.greatest(F.lit(1), F.least(rank, F.lit(len(colors)))))


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper-case, the rest lower-case."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")
