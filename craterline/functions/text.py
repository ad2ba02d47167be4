"""Identifiers, dates and display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from craterline.functions.common import first_of, fixed


def suffix(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def gap_id(entity_id: Column, tag: Column | str, n: int = 6) -> Column:
    """Display id only: two entities may share a suffix, so rows are keyed on (entity, gap type)."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("GAP-"), suffix(entity_id, n), F.lit("-"), tag)


def correspondence_id(source: Column, target: Column) -> Column:
    return F.concat_ws("-", F.lit("CORR"), source, target)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id from the key columns; the whole digest, since it is a join key."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat(F.lit(prefix), F.upper(digest))


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 date or date-time, with or without a zone; null when it does not parse."""
    return F.coalesce(F.try_to_timestamp(F.trim(c)), F.lit(None).cast("timestamp"))


def instrument_from_name(name: Column) -> Column:
    upper = F.upper(name)
    return first_of([
        (upper.contains("OHRC") | upper.contains("_OHR_"), "OHRC"),
        (upper.contains("TMC2") | upper.contains("TMC-2") | upper.contains("_TMC_"), "TMC-2"),
        (upper.contains("IIRS") | upper.contains("_IIR_"), "IIRS"),
    ])


def instrument_class(text: Column) -> Column:
    """Instrument name of a label mapped to its short form; other names stay as written."""
    upper = F.upper(text)
    return first_of([
        (upper.contains("OHRC") | upper.contains("HIGH RESOLUTION CAMERA"), F.lit("OHRC")),
        (upper.contains("TMC") | upper.contains("TERRAIN MAPPING CAMERA"), F.lit("TMC-2")),
        (upper.contains("IIRS") | upper.contains("INFRARED SPECTROMETER"), F.lit("IIRS")),
    ], text)


def gsd_text(gsd: Column) -> Column:
    return F.coalesce(F.concat(fixed(gsd, 2), F.lit(" m/px")), F.lit("UNKNOWN"))


def sun_text(azimuth: Column, elevation: Column) -> Column:
    text = F.concat(F.lit("Az="), fixed(azimuth, 1), F.lit("°, El="), fixed(elevation, 1), F.lit("°"))
    return F.coalesce(text, F.lit("UNKNOWN"))


def bounds_text(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    text = F.concat(F.lit("["), fixed(lat_min, 2), F.lit("°, "), fixed(lat_max, 2), F.lit("° N, "),
                    fixed(lon_min, 2), F.lit("°, "), fixed(lon_max, 2), F.lit("° E]"))
    return F.coalesce(text, F.lit("UNKNOWN"))


def dims_text(lines: Column, samples: Column) -> Column:
    text = F.when((lines > 0) & (samples > 0), F.concat(lines.cast("string"), F.lit("x"), samples.cast("string")))
    return F.coalesce(text, F.lit("UNKNOWN"))
