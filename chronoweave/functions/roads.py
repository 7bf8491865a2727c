"""Travel-mode profiles, speed limits and congestion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Straight-line speed presets, km/h.
SPEED_PRESETS = {"walking": 5.0, "cycling": 15.0, "transit": 30.0, "driving": 60.0}

# Road-class speeds, km/h.
DRIVING = {
    "motorway": 100, "motorway_link": 60, "trunk": 80, "trunk_link": 50, "primary": 60, "primary_link": 40,
    "secondary": 50, "secondary_link": 35, "tertiary": 40, "tertiary_link": 30, "unclassified": 35,
    "residential": 30, "living_street": 10, "service": 15, "track": 15,
}
CYCLING = {
    "cycleway": 18, "residential": 15, "living_street": 12, "service": 12, "path": 12, "track": 10, "footway": 8,
    "unclassified": 15, "tertiary": 18, "secondary": 18, "primary": 15, "tertiary_link": 12,
    "secondary_link": 12, "primary_link": 12,
}
WALKING = {"steps": 2.5}  # every other class walks at the default

# Classes a mode may not use.
EXCLUDED = {
    "driving": ("footway", "cycleway", "path", "steps", "bridleway", "pedestrian", "corridor", "elevator",
                "platform", "construction", "proposed"),
    "walking": ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed"),
    "cycling": ("motorway", "motorway_link", "trunk", "trunk_link", "steps", "construction", "proposed"),
}

# Minor classes that may be left out of a drawn result.
MINOR = {
    "driving": ("residential", "living_street", "service", "track", "unclassified"),
    "transit": ("residential", "living_street", "service", "track", "unclassified"),
    "custom": ("residential", "living_street", "service", "track", "unclassified"),
    "walking": ("service", "track", "steps", "corridor", "platform"),
    "cycling": ("service", "track", "steps", "corridor", "platform"),
}

# Through-road classes kept when a vehicle network is landed.
LANDED_CLASSES = {
    "driving": ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary",
                "secondary_link", "tertiary", "tertiary_link", "unclassified"),
    "transit": ("motorway", "trunk", "primary", "secondary", "tertiary", "primary_link", "secondary_link",
                "tertiary_link", "unclassified", "residential"),
}


@dataclass(frozen=True)
class ModeProfile:
    mode: str
    default_kmh: float
    max_kmh: float
    max_snap_m: float
    class_kmh: dict
    excluded: tuple = ()


def mode_profile(mode: str, custom_kmh: float | None = None) -> ModeProfile:
    """Profile by name; unknown names walk."""
    if mode == "custom" and custom_kmh is not None:
        v = max(0.1, float(custom_kmh))
        return ModeProfile("custom", v, v * 1.2, 300.0, {})
    table = {
        "driving": ModeProfile("driving", 30.0, 110.0, 500.0, DRIVING, EXCLUDED["driving"]),
        "cycling": ModeProfile("cycling", 15.0, 25.0, 100.0, CYCLING, EXCLUDED["cycling"]),
        "transit": ModeProfile("transit", 30.0, 40.0, 200.0, {}),
    }
    return table.get(mode, ModeProfile("walking", 5.0, 6.0, 50.0, WALKING, EXCLUDED["walking"]))


def class_speed_table(spark: SparkSession, profile: ModeProfile) -> DataFrame:
    """``(highway, class_kmh)`` - at most a few dozen fixed rows, safe to broadcast."""
    rows = [(k, float(v)) for k, v in profile.class_kmh.items()]
    return spark.createDataFrame(rows, "highway string, class_kmh double")


def preset_kmh(mode: Column, fallback_kmh: float) -> Column:
    m = F.lower(F.coalesce(mode, F.lit("")))
    out = F.lit(float(fallback_kmh))
    for name, kmh in SPEED_PRESETS.items():
        out = F.when(m == name, F.lit(kmh)).otherwise(out)
    return out


def mode_speed_kmh(mode: str, custom_kmh: float | None = None) -> float:
    v = float(custom_kmh if mode == "custom" and custom_kmh is not None else SPEED_PRESETS.get(mode, 5.0))
    if v <= 0:
        raise ValueError("travel speed must be greater than zero")
    return v


def maxspeed_kmh(tag: Column) -> Column:
    """``50``, ``30 mph``, ``50 km/h`` -> km/h; anything else (NaN too) is null."""
    s = F.lower(F.trim(tag.cast("string")))
    number = F.regexp_replace(s, r"\s*(mph|km/h)$", "").try_cast("double")
    value = F.when(s.endswith("mph"), number * 1.609344).otherwise(number)
    return F.when(~F.isnan(value), value)


def edge_kmh(tag_kmh: Column, class_kmh: Column, profile: ModeProfile) -> Column:
    wanted = F.coalesce(tag_kmh, class_kmh, F.lit(profile.default_kmh))
    return F.greatest(F.lit(0.5), F.least(wanted, F.lit(profile.max_kmh * 1.1)))


def congestion_factor(mid_ms: Column, lon: Column, mode: str) -> Column:
    """Share of free-flow speed by local solar hour; only motorised modes slow down."""
    if mode not in ("driving", "transit", "custom"):
        return F.lit(1.0)
    hour = F.floor(F.pmod(F.pmod(mid_ms / 3_600_000.0, F.lit(24.0)) + lon / 15.0, F.lit(24.0))).cast("int")
    # Rush hours, daytime hours, and the factor for each.
    return (F.when(hour.isin(7, 8, 16, 17, 18), F.lit(0.55))
            .when(hour.isin(6, 9, 10, 11, 12, 13, 14, 15, 19, 20), F.lit(0.75))
            .otherwise(F.lit(0.95)))


def clamp_factor(c: Column) -> Column:
    return F.greatest(F.lit(0.25), F.least(F.lit(1.5), c))


def resolve_speed_factor(adjustment: str, manual: float | None, calibrated: Column,
                         mid_ms: Column, lon: Column, mode: str) -> Column:
    """off -> 1; manual -> clamped value; auto -> calibrated, else congestion."""
    kind = (adjustment or "off").lower()
    if kind == "manual":
        return clamp_factor(F.lit(float(manual))) if manual is not None else F.lit(1.0)
    if kind != "auto":
        return F.lit(1.0)
    return F.coalesce(calibrated, F.least(F.lit(1.0), congestion_factor(mid_ms, lon, mode)))
