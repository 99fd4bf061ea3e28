"""Formulas as column expressions: scores, places, times, names and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: City population from which a metropolitan radius in km holds.
METRO_RADIUS_KM = ((5_000_000, 40.0), (1_000_000, 30.0), (500_000, 22.0), (200_000, 15.0), (100_000, 10.0))
#: Regions of continent codes.
REGIONS = {"NA": "americas", "SA": "americas", "EU": "europe", "AS": "asia", "AF": "africa", "OC": "oceania", "AN": "antarctica"}
#: Minutes to wait after the first, second ... failure.
RETRY_MINUTES = (5, 15, 60, 360, 1440)
EARTH_KM = 6371.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def display_score(similarity: Column, floor: float = 0.03, ceil: float = 0.13) -> Column:
    """A similarity on the scale that users see."""
    return clamp((similarity - floor) / (ceil - floor))


def similarity_of(distance: Column) -> Column:
    """Cosine similarity of unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def metro_radius_km(population: Column) -> Column:
    out = F.lit(0.0)
    for least, km in reversed(METRO_RADIUS_KM):
        out = F.when(population >= least, km).otherwise(out)
    return out


def region_of(continent: Column) -> Column:
    out = F.lit("")
    for code, region in REGIONS.items():
        out = F.when(continent == code, region).otherwise(out)
    return out


def cell(x: Column, size: float) -> Column:
    """A grid index, cut toward zero."""
    return (x / size).cast("int")


def half_degree_cell(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", (lat * 2).cast("int"), (lon * 2).cast("int"))


def spot_key(city: Column, lat: Column, lon: Column, size: float = 0.01) -> Column:
    return F.concat_ws(":", city, cell(lat, size), cell(lon, size))


def spot_parts(key: Column) -> list[Column]:
    parts = F.split(key, ":")
    return [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3)]


def place_name(city: Column, country: Column) -> Column:
    """"City, Country", the city alone, or blank without a city."""
    city, country = F.coalesce(city, F.lit("")), F.coalesce(country, F.lit(""))
    return F.when(city == "", "").when(country == "", city).otherwise(F.concat_ws(", ", city, country))


def place_name_or_country(city: Column, country: Column) -> Column:
    """As place_name, but the country alone without a city."""
    return F.when(F.coalesce(city, F.lit("")) == "", F.coalesce(country, F.lit(""))).otherwise(place_name(city, country))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of a SHA-1 of the parts, which are joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def trip_id(recipe: Column, start: Column) -> Column:
    """Stable while a trip begins in the same ISO week."""
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start), F.weekofyear(start))
    return short_id(recipe, week)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def retry_delay_ms(failures: Column) -> Column:
    ladder = F.array(*[F.lit(m * 60_000).cast("long") for m in RETRY_MINUTES])
    return F.element_at(ladder, F.greatest(F.lit(1), F.least(F.lit(len(RETRY_MINUTES)), failures)).cast("int"))


def face_quality(detection: Column, frontality: Column, sharpness: Column) -> Column:
    """A factor of up to 1; signals that are not known are neutral."""
    soft = lambda s: F.coalesce(0.5 + 0.5 * clamp(s), F.lit(1.0))
    return F.coalesce(clamp(detection), F.lit(1.0)) * soft(frontality) * soft(sharpness)


def cover_score(aesthetic: Column, area: Column, width: Column, height: Column, quality: Column) -> Column:
    """How well a face serves as cover; -1 where that can't be compared."""
    known = aesthetic.isNotNull() & (width > 0) & (height > 0) & (area > 0)
    return F.when(known, clamp((aesthetic - 1) / 9) * F.least(area / (width * height), F.lit(1.0)) * quality).otherwise(-1.0)


def sharpness(variance: Column) -> Column:
    return variance / (variance + 100)


def sprite_frames(duration_ms: Column) -> Column:
    """Preview frames: one a second up to 30 s, one every 2 s up to 120 s, then every 4 s; 5 to 120 of them."""
    s = F.floor(duration_ms / 1000)
    n = F.when(s <= 30, s).when(s <= 120, F.floor(s / 2)).otherwise(F.floor(s / 4))
    return F.least(F.lit(120), F.greatest(F.lit(5), n)).cast("int")


def document_verdict(margin: Column, regularity: Column, low: float, high: float, w_text: float = 0.65, w_lines: float = 0.35, floor: float = 0.5) -> Column:
    text = clamp((margin - low) / (high - low)) if high > low else F.lit(0.5)
    return w_text * text + w_lines * regularity >= floor - 1e-9


def crop_square(x1: Column, y1: Column, x2: Column, y2: Column, scale: Column, width: Column, height: Column) -> Column:
    """The square around a box, 1.3 times its longer side, on the thumbnail and within it."""
    side = F.greatest(x2 - x1, y2 - y1) * scale * 1.3
    cx, cy = (x1 + x2) / 2 * scale, (y1 + y2) / 2 * scale
    return F.struct(
        F.greatest(F.lit(0), (cx - side / 2).cast("int")).alias("left"),
        F.greatest(F.lit(0), (cy - side / 2).cast("int")).alias("top"),
        F.least(width, (cx + side / 2).cast("int")).alias("right"),
        F.least(height, (cy + side / 2).cast("int")).alias("bottom"),
    )


def fraction(text: Column) -> Column:
    """"30000/1001" or "25" as a number; 0 where it is none."""
    top, bottom = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(F.when(F.contains(text, F.lit("/")), F.when(bottom != 0, top / bottom)).otherwise(top), F.lit(0.0))


def iso6709(text: Column) -> Column:
    """"+37.77-122.41+010/" as (lat, lon); null where it isn't one."""
    pattern = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360))


def parsed_time(text: Column) -> Column:
    """The five layouts that times are stored in."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]XXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])


def canonical_text(text: Column) -> Column:
    """White space collapsed, punctuation gone, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"\p{Punct}", ""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def title_of(answer: Column, most_words: int = 6, quotes: bool = True) -> Column:
    """The first line without spaces of any kind around it, nor quotes unless they are kept, 80 characters at most; blank where it has too many words."""
    trimmed = lambda c: F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")
    first = F.split_part(trimmed(answer), F.lit("\n"), F.lit(1))
    line = F.substring(trimmed(F.regexp_replace(first, "^[\"'“”]+|[\"'“”]+$", "") if quotes else first), 1, 80)
    return F.when(F.size(F.split(line, r"[\t\n\f\r ]+")) > most_words, "").otherwise(line)


def fits_quota(size: Column, free: Column) -> Column:
    return size * 1.05 <= free


def quad_area(q: Column) -> Column:
    """Shoelace area of a quad of eight numbers; 0 for other lengths."""
    x, y = (lambda i: q[2 * (i % 4)]), (lambda i: q[2 * (i % 4) + 1])
    total = sum((x(i) * y(i + 1) - x(i + 1) * y(i) for i in range(4)), F.lit(0.0))
    return F.when(F.size(q) == 8, F.abs(total) / 2).otherwise(0.0)
