"""Column expressions for cleaning, clipping, ratios and weather readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: layout of the packed weather columns
PACKED_LAYOUT = {
    "WND": [
        "WND_direction_angle",
        "WND_direction_quality_code",
        "WND_type",
        "WND_speed",
        "WND_speed_quality_code",
    ],
    "CIG": [
        "CIG_ceiling_height_dimension",
        "CIG_ceiling_quality_code",
        "CIG_ceiling_determination_code",
        "CIG_ceiling_and_visibility_okay_CAVOK",
    ],
    "VIS": [
        "VIS_distance_dimension",
        "VIS_distance_quality_code",
        "VIS_variability_code",
        "VIS_quality_variability_code",
    ],
    "TMP": ["TMP_air_temperature", "TMP_air_temperature_quality_code"],
    "DEW": ["DEW_dew_point_temperature", "DEW_dew_point_quality_code"],
    "SLP": ["SLP_sea_level_pressure", "SLP_sea_level_pressure_quality_code"],
}
# fixed values: readings that mean "missing", accepted quality codes
MISSING_READING = {
    "WND_direction_angle": 999,
    "WND_speed": 9999,
    "CIG_ceiling_height_dimension": 99999,
    "VIS_distance_dimension": 999999,
    "TMP_air_temperature": 9999,
    "DEW_dew_point_temperature": 9999,
    "SLP_sea_level_pressure": 99999,
}
GOOD_QUALITY = [0, 1, 4, 5, 9]
# fixed values: readings written with a sign
SIGNED_READING = ("TMP_air_temperature", "DEW_dew_point_temperature")
# fixed values: bad-weather thresholds (ratio, m/s, hPa, m)
HUMIDITY_MIN, WIND_MIN, PRESSURE_MAX, VISIBILITY_MAX = 0.5, 15.2, 1006.6, 1609.344
# fixed values: first hour of each part of the day
DAY_PARTS = [(5, 12, "Morning"), (12, 17, "Afternoon"), (17, 21, "Evening")]


def unpack_composite(
    df: DataFrame,
    layout: Mapping[str, Sequence[str]] = PACKED_LAYOUT,
    types: Mapping[str, str] | None = None,
    signed: Sequence[str] = SIGNED_READING,
    sep: str = ",",
) -> DataFrame:
    """Replace packed string columns by one column per part, cast where ``types`` names one.

    Each packed text is split once.  The parts leave through a generator, so a
    later filter on them is not rewritten into a second round of splitting.
    A leading plus is dropped from ``signed`` parts; text that does not parse is null.
    """
    keep = [c for c in df.columns if c not in layout]
    types = types or {}

    def part(packed: str, i: int, name: str) -> Column:
        text = F.get(F.col(f"_{packed}"), F.lit(i))
        if name in types:
            plain = F.replace(text, F.lit("+"), F.lit("")) if name in signed else text
            return plain.try_cast(types[name]).alias(name)
        return text.alias(name)

    pieces = df.select(*keep, *[F.split(F.col(packed), sep).alias(f"_{packed}") for packed in layout])
    parts = F.struct(*[part(packed, i, n) for packed, names in layout.items() for i, n in enumerate(names)])
    return pieces.select(*keep, F.inline(F.array(parts)))


def cast_tolerant(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast many columns in one projection; text that does not parse becomes null."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def strip_plus_scaled(c: Column, scale: float = 10.0) -> Column:
    """``'+0123'`` to 12.3; text that does not parse becomes null."""
    return F.regexp_replace(c, r"\+", "").try_cast("double") / scale


def quality_filter(df: DataFrame, name_suffix: str = "US") -> DataFrame:
    """Keep readings of this country (or unnamed stations) with good codes and no missing mark."""
    keep = (F.right(F.col("NAME"), F.lit(2)) == name_suffix) | (F.col("NAME") == "")
    for column, missing in MISSING_READING.items():
        if column in df.columns:
            keep = keep & (F.col(column) != missing)
    for column in df.columns:
        if column.endswith("quality_code"):
            keep = keep & F.col(column).isin(GOOD_QUALITY)
    return df.where(keep)


def relative_humidity(dew: Column, air: Column) -> Column:
    """Ratio of the Magnus vapour pressures at dew point and air temperature."""
    def pressure(t: Column) -> Column:
        return F.exp((17.625 * t) / (243.04 + t))

    return pressure(dew) / pressure(air)


def bad_weather_flag(dew: Column, air: Column, wind: Column, pressure: Column, visibility: Column) -> Column:
    rough = (wind >= WIND_MIN) | (pressure <= PRESSURE_MAX) | (visibility <= VISIBILITY_MAX)
    return indicator((relative_humidity(dew, air) > HUMIDITY_MIN) & rough)


def indicator(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def hhmm_to_hour(c: Column) -> Column:
    """Hour of an ``HHmm`` clock text of one to four digits; 2400 is hour 0, other text null."""
    return (F.floor(c.cast("string").try_cast("int") / 100) % 24).cast("int")


def part_of_day(hour: Column) -> Column:
    out = F
    for start, stop, name in DAY_PARTS:
        out = out.when((hour >= start) & (hour < stop), name)
    return out.otherwise("Night")


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; null stays null although greatest and least skip nulls."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def clamped_ratio(part: Column, base: Column, bound: float = 5.0) -> Column:
    """part/base in ``[-bound, bound]``; x/0 keeps its sign at the bound, 0/0 and null give 0."""
    ratio = F.when(base != 0, part / base).when(part != 0, F.signum(part) * bound)
    return F.coalesce(clip(ratio, -bound, bound), F.lit(0.0))


def abs_ratio_of_base(c: Column, base: Column, bound: float = 5.0) -> Column:
    return clamped_ratio(F.abs(c), F.abs(base), bound)


def abs_ratio_of_positive_base(c: Column, base: Column, bound: float = 5.0) -> Column:
    """As above, but a base of zero or below gives 0."""
    return F.when(base > 0, abs_ratio_of_base(c, base, bound)).otherwise(F.lit(0.0))


def change_from(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.abs(before))


def enterprise_value(market_cap: Column, cash: Sequence[Column], debt: Sequence[Column]) -> Column:
    total = market_cap
    for c in cash:
        total = total - F.coalesce(c, F.lit(0))
    for d in debt:
        total = total + F.coalesce(d, F.lit(0))
    return total


def daily_rate(yearly_percent: Column) -> Column:
    return F.pow(yearly_percent / 100 + 1, F.lit(1 / 365)) - 1


def box_cox(c: Column, lam: float) -> Column:
    return F.log(c) if lam == 0 else (F.pow(c, F.lit(lam)) - 1) / lam


def sigmoid(weights: Sequence[float], inputs: Sequence[Column]) -> Column:
    """Logistic of a linear score; ``weights[0]`` is the intercept."""
    score = F.lit(weights[0])
    for w, x in zip(weights[1:], inputs, strict=True):
        score = score + w * x
    return 1 / (1 + F.exp(-score))


def map_literal(pairs: Mapping, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[key]


def multi_hot(tags: Column, vocabulary: Sequence[str]) -> Column:
    return F.array(*[F.array_contains(tags, v).cast("int") for v in vocabulary])


def pad_identifier(c: Column, width: int = 9) -> Column:
    return F.lpad(c, width, "0")


def drop_check_digit(c: Column, width: int = 8) -> Column:
    return c.substr(1, width)


def token_recode(c: Column, missing: Sequence[str] = ("NR",), tokens: Mapping[str, str] | None = None) -> Column:
    """Survey text to a percentage: missing marks to null, ``<.01`` style tokens to numbers."""
    out = c
    for text, number in (tokens or {"<.01": "0.001"}).items():
        out = F.when(out == text, F.lit(number)).otherwise(out)
    for mark in missing:
        out = F.nullif(out, F.lit(mark))
    return out.try_cast("double") * 100


def first_city(c: Column) -> Column:
    """``'A/B, ST'`` to ``'A'``."""
    return F.split_part(F.split_part(c, F.lit(","), F.lit(1)), F.lit("/"), F.lit(1))
