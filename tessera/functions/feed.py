"""Columns over risk feeds: situations, levels, dates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feed.
ZONES = tuple(range(53, 60))
ZONE_CODES = ("1N", "1S", "2", "3", "4", "5", "6")
SITUATIONS = tuple(range(1, 10))
ADVISORY = 3
LEVEL_RGB = {1: (0xA4, 0xCC, 0x87), 2: (0xFF, 0x97, 0x00), 3: (0xE8, 0x3D, 0x35)}
STALE_RGB = (0x80, 0x80, 0x80)
STRIPE = 0.55
LOCAL_ZONE = "Europe/Madrid"


def level(situation: Column) -> Column:
    """Three situations to a level; null outside 1 to 9."""
    return F.when(situation.between(1, 9), F.floor((situation - 1) / 3) + 1).cast("int")


def access(risk: Column) -> Column:
    return F.when(risk == 3, "closed_by_mvp_rule").otherwise("unrestricted_by_mvp_rule")


def valid_local_timestamp(text: Column) -> Column:
    r"""'YYYY-MM-DD HH:MM:SS' with up to three digits of a second, that exists; years below 100, second 60 and hour 24 don't.

    \z, as $ would allow a final line end.
    """
    form = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,3})?\z")
    real = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(form & real.isNotNull() & (F.substring(text, 1, 4) >= "0100"), F.lit(False))


def valid_instant(text: Column) -> Column:
    """An ISO instant in UTC with milliseconds that reads back as itself."""
    real = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z") & real.isNotNull(), F.lit(False))


def source_date(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 10)


def next_date(date: Column) -> Column:
    """The next calendar date, as text."""
    return F.date_format(F.date_add(F.to_date(date), 1), "yyyy-MM-dd")


def local_date(instant: Column) -> Column:
    """Calendar date of an instant (session zone UTC) at the feed's place, as text."""
    return F.date_format(F.from_utc_timestamp(instant, LOCAL_ZONE), "yyyy-MM-dd")


def stale(timestamp: Column, now: Column) -> Column:
    """Whether a state of this source timestamp is of another local date than now."""
    return source_date(timestamp) != local_date(now)


def snapshot_id(date: Column, current: Column, forecast: Column | None = None) -> Column:
    """sha256: and the digest of compact JSON of a date and arrays of (zone, level) in zone order; without forecast, the first version's form.

    Situation ids and times are left out: another situation of the same level is the same snapshot.
    """

    def pairs(zones: Column) -> Column:
        return F.transform(zones, lambda z: F.array(z["zone_id"], z["level"]))

    if forecast is None:
        value = F.struct(date.alias("sourceDate"), pairs(current).alias("levels"))
    else:
        value = F.struct(date.alias("sourceDate"), pairs(current).alias("currentLevels"), pairs(forecast).alias("forecastNextDayLevels"))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(value), 256))


def stripe(channel: Column) -> Column:
    """A colour channel of the dark stripe, rounded half up."""
    return F.floor(channel * F.lit(STRIPE) + F.lit(0.5)).cast("int")


def cache_tag(snapshot: Column, period: Column, old: Column, date: Column) -> Column:
    """Key of a rendering: by snapshot and period, and by date too while stale; without snapshot by period and date."""
    known = F.concat_ws(":", snapshot, period, F.when(old, F.concat(F.lit("stale-"), date)).otherwise("current"))
    return F.when(snapshot.isNull(), F.concat_ws(":", F.lit("unavailable"), period, date)).otherwise(known)


def etag(tag: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit('"'), F.concat_ws("-", F.translate(tag, ":", "-"), z, x, y), F.lit('"'))


def etag_matches(header: Column, own: Column) -> Column:
    """If-None-Match: a list with the tag or a star."""
    return F.coalesce(F.exists(F.split(header, ","), lambda x: (F.trim(x) == "*") | (F.trim(x) == own)), F.lit(False))


def utc_text(instant: Column) -> Column:
    """An instant (session zone UTC) as ISO text to the second."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def latest_instant(*instants: Column) -> Column:
    """The last of ISO instants, which compare as text."""
    return F.greatest(*instants)


def valid_date(text: Column) -> Column:
    """'YYYY-MM-DD' that exists."""
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def colour(text: Column) -> Column:
    """Red, green and blue of '#RRGGBB', '#' may be left out; null for other text."""
    digits = F.regexp_extract(text, r"^#?([0-9A-Fa-f]{6})\z", 1)
    return F.when(digits != "", F.array(*[F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]))


def valid_palette(colours: Column, size: int = 7) -> Column:
    """Whether there are so many colours of three channels from 0 to 255."""
    one = F.forall(colours, lambda c: (F.size(c) == 3) & F.forall(c, lambda v: v.between(0, 255)))
    return F.coalesce((F.size(colours) == size) & one, F.lit(False))
