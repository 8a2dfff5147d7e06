"""Preset profiles as a table: limits and weights of a person, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")
# Seconds added per second on a surface; None is never taken.
SMOOTH = {"asphalt": 0.0, "concrete": 0.0, "paving_stones": 0.1, "sett": 0.6, "cobblestone": 1.0, "compacted": 0.4, "fine_gravel": 0.6, "gravel": None, "grass": None, "wood": 0.1, "metal": 0.2, "other": 0.5}
ANY = {"asphalt": 0.0, "concrete": 0.0, "paving_stones": 0.0, "sett": 0.05, "cobblestone": 0.1, "compacted": 0.0, "fine_gravel": 0.0, "gravel": 0.1, "grass": 0.2, "wood": 0.0, "metal": 0.0, "other": 0.1}

# Preset, speed m/s, most % up, down, comfortable %, camber %, kerb cm, least width m, steps, escalators, wet factor, rest m,
# toilet m, tolerance, surfaces, changed surfaces.
PRESETS = (
    ("walking", 1.3, 100.0, 100.0, 10.0, 100.0, 30.0, 0.4, INF, True, 1.0, None, None, 1.0, ANY, {}),
    ("manual-wheelchair", 1.0, 8.0, 8.0, 4.0, 4.0, 0.6, 0.9, 0.0, False, 1.8, None, None, 0.3, SMOOTH, {}),
    ("manual-wheelchair-companion", 1.1, 10.0, 9.0, 5.0, 6.0, 6.0, 0.9, 0.0, False, 1.5, None, None, 0.4, SMOOTH, {"sett": 0.4, "cobblestone": 0.8}),
    ("powerchair", 1.4, 12.0, 10.0, 8.0, 6.0, 5.0, 1.0, 0.0, False, 1.3, None, None, 0.3, SMOOTH, {"sett": 0.3, "cobblestone": 0.6, "compacted": 0.2, "fine_gravel": 0.3}),
    ("powerchair-light", 1.3, 8.0, 8.0, 5.0, 4.0, 3.0, 0.8, 0.0, False, 1.6, None, None, 0.25, SMOOTH, {"sett": 0.9, "cobblestone": None, "compacted": 0.5, "fine_gravel": 0.8}),
    ("mobility-scooter", 1.8, 10.0, 10.0, 6.0, 5.0, 5.0, 1.1, 0.0, False, 1.3, None, None, 0.3, SMOOTH, {"sett": 0.4}),
    ("mobility-scooter-road", 1.8, 12.0, 10.0, 7.0, 6.0, 7.0, 1.2, 0.0, False, 1.3, None, None, 0.3, SMOOTH, {"sett": 0.3, "cobblestone": 0.6, "compacted": 0.2, "fine_gravel": 0.4}),
    ("rollator", 0.8, 10.0, 10.0, 5.0, 5.0, 6.0, 0.7, 2.0, False, 1.6, 300.0, None, 0.4, SMOOTH, {"sett": 0.7}),
    ("walking-stick", 1.0, 14.0, 12.0, 6.0, 8.0, 15.0, 0.7, 30.0, True, 1.8, 50.0, None, 0.6, ANY, {"sett": 0.3, "cobblestone": 0.5, "gravel": 0.4, "grass": 0.5}),
    ("crutches", 0.8, 12.0, 10.0, 5.0, 8.0, 15.0, 0.9, 20.0, True, 2.0, 50.0, None, 0.6, ANY, {"sett": 0.4, "cobblestone": 0.7, "gravel": 0.6, "grass": 0.8}),
    ("pram", 1.2, 14.0, 14.0, 7.0, 8.0, 8.0, 0.7, 0.0, False, 1.2, None, None, 0.6, SMOOTH, {"sett": 0.3, "gravel": 0.8, "grass": 1.0}),
    ("fatigue", 0.9, 10.0, 14.0, 4.0, 10.0, 20.0, 0.5, 15.0, True, 1.2, 100.0, 800.0, 0.6, ANY, {}),
    ("visual-impairment", 1.1, 100.0, 100.0, 10.0, 100.0, 30.0, 0.9, INF, True, 1.0, None, None, 0.5, ANY, {}),
)
# What single presets set besides.
ROAD_SPEED = {"mobility-scooter-road": 3.576}
CUES = {"visual-impairment": (240.0, 60.0, 120.0, 45.0)}
PER_100_M = {"visual-impairment": (60.0, 60.0)}

SCHEMA = (
    "preset string, speed double, max_up double, max_down double, comfort double, camber double, kerb_cm double, min_width double, max_steps double, escalators boolean, wet_factor double, rest_m double, toilet_m double, tolerance double, "
    "surfaces map<string,double>, buses boolean, road_legal boolean, road_speed double, scooter_permit boolean, max_gap_mm double, cues struct<uncontrolled:double,zebra:double,silent:double,no_tactile:double>, shared_per_100m double, lit_per_100m double"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def preset_rows() -> list[tuple]:
    out = []
    for *head, surfaces, changed in PRESETS:
        name = head[0]
        shared, lit = PER_100_M.get(name, (None, None))
        out.append((*head, surfaces | changed, name not in ROAD_SPEED, name in ROAD_SPEED, ROAD_SPEED.get(name), False, None, CUES.get(name), shared, lit))
    return out


def presets(spark: SparkSession) -> DataFrame:
    """One row a preset, named in `preset`, its values in the struct `p`."""
    df = spark.createDataFrame(preset_rows(), SCHEMA)
    return df.select("preset", F.struct(*FIELDS).alias("p"))


def preset(name: str) -> F.Column:
    """A preset as a literal struct, for one person."""
    row = next(r for r in preset_rows() if r[0] == name)
    kinds = dict(zip(FIELDS, (x.split(" ", 1)[1] for x in SCHEMA.split(", ")), strict=True))
    out = []
    for field, value in zip(FIELDS, row, strict=True):
        if field == "surfaces":
            value = F.create_map(*[F.lit(x) if x is not None else F.lit(None).cast("double") for k, v in value.items() for x in (k, v)])
        elif field == "cues":
            value = F.lit(None) if value is None else F.struct(*[F.lit(v).alias(n) for n, v in zip(("uncontrolled", "zebra", "silent", "no_tactile"), value, strict=True)])
        out.append((value if isinstance(value, F.Column) else F.lit(value)).cast(kinds[field]).alias(field))
    return F.struct(*out)
