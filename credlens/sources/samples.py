"""Two small tables to try an analysis on, made by rule: measured-looking readings of a nutrient tank, and the same columns as
someone might draw them with a ruler."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("real", "fake")
ROWS, STEP, START = 90, 1200, 1_717_373_400  # readings, seconds between them, seconds since 1970


def sample(spark: SparkSession, kind: str) -> DataFrame:
    """read_at, tank_ph, tank_ec, co2_ppm and pump_weight of ROWS readings. Any other kind is an error."""
    if kind not in KINDS:
        raise ValueError(f"unknown sample {kind!r}: there are {', '.join(KINDS)}")
    i = F.col("id").cast("double")
    noise = lambda k: sum((F.pmod(F.xxhash64("id", F.lit(10 * k + j)), F.lit(1009)) for j in range(3)), F.lit(0)) / 1008.0 - 1.5  # noqa: E731  bell-shaped, within 1.5
    tide = lambda hours, late: F.sin((i * STEP / 3600 - late) * (2 * math.pi / hours))
    readings = {
        "real": {
            "tank_ph": F.round(6.1 + 0.12 * tide(9, 2) + 0.11 * noise(1), 2), "tank_ec": F.round(2.3 + 0.2 * tide(17, 5) + 0.13 * noise(2), 2),
            "co2_ppm": F.round(640 - 110 * tide(24, 7) + 47 * noise(3)), "pump_weight": F.round(14.2 + 0.9 * tide(13, 1) + 0.8 * noise(4), 1),
        },
        "fake": {
            "tank_ph": F.round(7.4 - i / 64, 4), "tank_ec": F.round(1.1 + i / 40, 4),
            "co2_ppm": 410 + 3.0 * i, "pump_weight": F.round(20 - i / 8, 4),
        },
    }
    at = F.timestamp_seconds(F.lit(START) + STEP * F.col("id")).alias("read_at")
    return spark.range(ROWS).select(at, *[c.alias(n) for n, c in readings[kind].items()])
