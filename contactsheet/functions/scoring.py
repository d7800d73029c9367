"""Scores, bands and ladders as column expressions. Thresholds are parameters with the reference's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the result bands, of the print tiers, and of the sample tiers.
RESULT_BANDS = [(6.68, "Exceptional"), (6.52, "Strong"), (6.22, "Solid"), (5.99, "Weak")]
PRINT_TIERS = [(7.0, "fine_art"), (6.5, "standard")]
SAMPLE_TIERS = [(7.0, "high"), (6.5, "mid_high"), (6.0, "mid"), (5.5, "mid_low"), (0.0, "low")]
#: Weights of the cull signals and of the ensemble.
CULL_WEIGHTS = {"zone_sharpness": 0.30, "edge_density": 0.15, "frequency_ratio": 0.10, "highlight_clip": 0.15, "shadow_clip": 0.10, "dynamic_range": 0.10, "noise": 0.10}
ENSEMBLE_WEIGHTS = {"technical": 0.30, "aesthetic": 0.35, "composition": 0.20, "exif": 0.15}
#: Seasons by month, and pillars by weekday from Monday.
SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer"}
PILLARS = ["transformation", "genre_spotlight", "bts", "social_proof", "personality", "flexible", "flexible"]
GENRES = ["wedding", "portrait", "boudoir", "commercial", "events", "nature"]


def banded(x: Column, bands: list[tuple[float, str]], below: str | None) -> Column:
    """PRJ-01, FLT-15. The first band whose lower bound x reaches; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in sorted(bands, reverse=True):
        out = out.when(x >= bound, name)
    return out.otherwise(F.lit(below).cast("string"))


def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    """PRJ-02, PRJ-08. The name of the first condition that holds; an unknown one doesn't."""
    first, *rest = steps
    out = F.when(first[0], first[1])
    for cond, name in rest:
        out = out.when(cond, name)
    return out.otherwise(otherwise)


def photo_status(outcome: Column, duplicate: Column, posted_at: Column, print_worthy: Column, portfolio: Column, ready: Column, score: Column) -> Column:
    """PRJ-02. What a photo is shown as: what the first pass made of it, then what has become of it, then whether it has a score."""
    steps = [(outcome == x, x.capitalize()) for x in ("missing", "corrupt", "video", "sidecar")]
    steps += [(duplicate | F.coalesce(outcome == "duplicate", F.lit(False)), "Burst"), (outcome == "fail", "Culled"), (posted_at.isNotNull(), "Posted")]
    return ladder([*steps, (print_worthy, "Print"), (portfolio, "Portfolio"), (ready, "Ready"), (score.isNull(), "Pending")], "Scored")


def weakest(scores: dict[str, Column], floor: float = 5.0) -> Column:
    """PRJ-03. The name of the least score below floor, the first listed of several; null if none is."""
    each = [F.when(c.isNotNull(), F.struct(c.cast("double").alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, c) in enumerate(scores.items())]
    least = F.array_min(F.array_compact(F.array(*each)))
    return F.when(least["s"] < floor, least["n"])


def note(*choices: Column, most: int = 180) -> Column:
    """PRJ-04. The first text that isn't empty, cut."""
    return F.substring(F.coalesce(*(F.nullif(c, F.lit("")) for c in choices)), 1, most)


def trust(rating: Column, nima: Column, quality: Column) -> Column:
    """PRJ-05."""
    zero = F.lit(0.0)
    total = F.coalesce(rating * 2.0, zero) + F.coalesce(nima, zero) + F.coalesce(quality, zero)
    return F.round(F.least(total / 30.0 * 10.0, F.lit(10.0)), 4)


def combined(nima: Column, quality: Column) -> Column:
    """PRJ-06. 0.6 and 0.4 of the two, null as 0."""
    return F.lit(0.6) * F.coalesce(nima, F.lit(0.0)) + F.lit(0.4) * F.coalesce(quality, F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def blend(parts: dict[str, Column], weights: dict[str, float], missing: float | None = None) -> Column:
    """UDF-09, UDF-12. The weighted sum, clamped and rounded; a missing part counts as given, else makes the whole null."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + (parts[name] if missing is None else F.coalesce(parts[name], F.lit(missing))) * w
    return F.round(clamp(total), 3)


def cull_status(score: Column, raw: Column) -> Column:
    return F.when(score >= 4.5, "pass").when((score >= 3.0) & raw, "raw_review").otherwise("fail")


def exif_score(aperture: Column, iso: Column, raster: Column) -> Column:
    """PRJ-12. Rasters are flat; else 5 with what the aperture and the sensitivity add."""
    a = F.when(aperture.between(4, 8), 2.5).when(((aperture >= 2.8) & (aperture < 4)) | ((aperture > 8) & (aperture <= 11)), 1.5)
    a = a.when(((aperture >= 1.4) & (aperture < 2.8)) | ((aperture > 11) & (aperture <= 16)), 0.5).otherwise(0.0)
    i = F.when(iso.isNull(), 0.0).when(iso <= 400, 2.5).when(iso <= 1600, 1.5).when(iso <= 3200, 0.5).when(iso <= 6400, -0.5).otherwise(-1.0)
    return F.when(raster, 7.5).otherwise(clamp(a + i + 5.0))


def season(day: Column) -> Column:
    """PRJ-13."""
    out = F.when(day.isNull(), F.lit(None).cast("string"))
    for name in ("winter", "spring", "summer"):
        out = out.when(F.month(day).isin([m for m, s in SEASONS.items() if s == name]), name)
    return out.otherwise("autumn")


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    out = F.when((h >= 5) & (h < 7), "blue_hour_morning").when((h >= 7) & (h < 9), "golden_hour_morning").when((h >= 9) & (h < 16), "midday")
    return out.when((h >= 16) & (h < 19), "golden_hour_evening").when((h >= 19) & (h < 21), "blue_hour_evening").otherwise("night")


def creative_intent(shutter: Column, aperture: Column, focal: Column) -> Column:
    return ladder(
        [
            (shutter >= 1, "long_exposure_intentional"),
            (shutter <= 0.001, "motion_freeze"),
            (aperture <= 2.0, "shallow_dof_portrait_or_low_light"),
            ((aperture >= 8) & (focal <= 35), "landscape_deep_focus"),
        ],
        "standard",
    )


def palette(text: Column, warm: list[str], cool: list[str]) -> Column:
    """PRJ-14. Which of two word lists has more words in the text."""
    hits = lambda words: sum((F.lower(text).contains(w).cast("int") for w in words), F.lit(0))
    return F.when(text.isNull(), "neutral").when(hits(warm) > hits(cool), "warm").when(hits(cool) > hits(warm), "cool").otherwise("neutral")


def edition_alert(sold: Column, size: Column, retired: Column) -> Column:
    """PRJ-11. Null below half; an edition without a size is none."""
    pct = F.when(size > 0, sold * 100.0 / size)
    return F.when(retired | (pct >= 100), "sold_out").when(pct >= 80, "near_sold_out").when(pct >= 50, "half_sold")


def suggested_prints(score: Column, sizes: list[tuple[float, list[tuple[str, float]]]]) -> Column:
    """PRJ-10. The sizes and prices of the first step that the score reaches; the last step is for all."""
    rows = lambda prints: F.array(*(F.struct(F.lit(n).alias("size"), F.lit(p).alias("price")) for n, p in prints))
    (first, prints), *rest = sizes
    out = F.when(score >= first, rows(prints))
    for bound, prints in rest:
        out = out.when(score >= bound, rows(prints))
    return out


def iso_week_genre(day: Column) -> Column:
    """The genre of the ISO week's rotation."""
    return F.element_at(F.array(*map(F.lit, GENRES)), (F.pmod(F.weekofyear(day) - 1, F.lit(len(GENRES))) + 1).cast("int"))


def pillar(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PILLARS)), (F.weekday(day) + 1).cast("int"))


def next_anniversary(day: Column, as_of: Column) -> Column:
    """The next return of a day from as_of on; null where a year lacks it, as the 29th of February."""
    this, later = _made(F.year(as_of), day), _made(F.year(as_of) + 1, day)
    return F.when(this >= as_of, this).when(this < as_of, later)


def _made(year: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.month(day), F.dayofmonth(day)), "yyyy-MM-dd")


def daylight(lat: Column, lon: Column, day: Column) -> Column:
    """Sunrise and sunset in minutes of the UTC day by the declination of the day of the year; at a polar day or night the arc is the whole or none."""
    turn = (F.dayofyear(day) - 1) * (2 * 3.141592653589793 / 365)
    # The coefficients of the public solar formula.
    decl = 0.006918 - 0.399912 * F.cos(turn) + 0.070257 * F.sin(turn) - 0.006758 * F.cos(2 * turn) + 0.000907 * F.sin(2 * turn) - 0.002697 * F.cos(3 * turn) + 0.00148 * F.sin(3 * turn)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(turn) - 0.032077 * F.sin(turn) - 0.014615 * F.cos(2 * turn) - 0.04089 * F.sin(2 * turn))
    x = F.cos(F.radians(F.lit(90.833))) / (F.cos(F.radians(lat)) * F.cos(decl)) - F.tan(F.radians(lat)) * F.tan(decl)
    arc = F.degrees(F.acos(clamp(x, -1.0, 1.0)))
    noon = 720 - 4 * lon - eq
    return F.struct(F.round(noon - 4 * arc, 4).alias("sunrise"), F.round(noon + 4 * arc, 4).alias("sunset"))


def eastern_minutes(day: Column, utc_minutes: Column) -> Column:
    """Minutes of the local day: four hours behind from April to October, else five."""
    return F.pmod(utc_minutes + F.when(F.month(day).between(4, 10), -240).otherwise(-300), F.lit(1440))


def clock(minutes: Column) -> Column:
    """Minutes of a day as h:mm AM or PM."""
    h, m = F.floor(minutes / 60).cast("int"), F.floor(F.pmod(minutes, F.lit(60))).cast("int")
    return F.format_string("%d:%02d %s", F.when(h % 12 == 0, 12).otherwise(h % 12), m, F.when(h < 12, "AM").otherwise("PM"))


def golden_hours(lat: Column, lon: Column, day: Column) -> Column:
    """The first 45 minutes after sunrise and the last 60 before sunset, as clock times of the local day."""
    sun = daylight(lat, lon, day)
    up, down = (F.floor(eastern_minutes(day, sun[x])) for x in ("sunrise", "sunset"))
    at = lambda x: clock(F.pmod(x, F.lit(1440)))
    return F.struct(at(up).alias("sunrise"), at(up + 45).alias("morning_end"), at(down - 60).alias("evening_start"), at(down).alias("sunset"))


def exif_time(text: Column) -> Column:
    """A timestamp as cameras write it, YYYY:MM:DD HH:MM:SS; null if it isn't one."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss"))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a number, negative in the south and west."""
    out = d + m / 60.0 + s / 3600.0
    return F.round(F.when(ref.isin("S", "W"), -out).otherwise(out), 7)


def apex_shutter(apex: Column) -> Column:
    """An exposure in APEX units as a time: a fraction below a second, else seconds."""
    t = F.pow(F.lit(2.0), -apex)
    return F.when(t < 1, F.concat(F.lit("1/"), F.rint(1 / t).cast("long").cast("string"))).otherwise(F.round(t, 3).cast("string"))


def slot_time(day: Column, slot: Column, morning: int = 9, evening: int = 18) -> Column:
    """The instant of a day's slot in New York, with its summer time."""
    local = F.concat(F.date_format(day, "yyyy-MM-dd"), F.when(slot == "morning", F.format_string("T%02d:00:00", F.lit(morning))).otherwise(F.format_string("T%02d:00:00", F.lit(evening))))
    return F.to_utc_timestamp(local, "America/New_York")
