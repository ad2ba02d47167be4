"""Label adapters: which files they take, and how they read the fields of a product from its label.

An adapter is a table row: its name, the parts of a file name or the extensions that lead to it, the
tags it looks for, and functions that build one column expression for each field. The first adapter
of a list that takes a file reads it, so a user's own go in front: ``(MINE, *ADAPTERS)``. Fields that
an adapter does not give are null, but for the product id (the file's name) and the number of bands (1).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import text as T
from craterline.functions.common import any_of, first_of

ANGLES = ("sun_azimuth_deg", "sun_elevation_deg", "incidence_angle_deg", "emission_angle_deg", "phase_angle_deg")
#: Every field that an adapter may give, with its type.
FIELDS = {"product_id": "string", "mission": "string", "processing_level": "string", "acquisition_time": "timestamp", **dict.fromkeys(ANGLES, "double"),
          "spacecraft_altitude_km": "double", "lat_min": "double", "lat_max": "double", "lon_min": "double", "lon_max": "double", "crs": "string", "gsd_m": "double",
          "lines": "int", "samples": "int", "num_bands": "int", "bands": "array<struct<center_wavelength_nm:double>>", "data_type": "string"}


def decoded(c: Column) -> Column:
    """Text with the five named entities written out."""
    plain = c
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(letter))
    return F.when(c.contains("&"), plain).otherwise(c)


def blank(c: Column) -> Column:
    text = decoded(F.trim(c))
    return F.when(F.length(text) > 0, text)


def blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^<>]*)?>(.*?)</{tag}>"), F.lit(1))


def inside(block: Column, tag: str) -> Column:
    return blank(F.regexp_extract(block, rf"<{tag}(?:\s[^<>]*)?>([^<]*)</{tag}>", 1))


@dataclass(frozen=True)
class LabelText:
    """What an adapter's functions may read of a label; ``tags`` are those whose texts were looked up."""
    tags: tuple[str, ...]
    file_name: Column
    xml: Column

    def first(self, *tags: str) -> Column:
        """Text of the first leaf of the first tag that occurs; an empty one gives null without looking further."""
        return F.nullif(F.coalesce(*[F.get("_found", F.lit(self.tags.index(t))) for t in tags if t in self.tags], F.lit("")), F.lit(""))

    def number(self, *tags: str) -> Column:
        return self.first(*tags).try_cast("double")

    def component(self, pattern: str) -> Column:
        """Name of the last observing system component of a kind."""
        return F.try_element_at(F.filter("_parts", lambda p: p["kind"].rlike(pattern) & p["name"].isNotNull()), F.lit(-1))["name"]

    def axis(self, word: str) -> Column:
        """Elements along the last axis of the array whose name has the word."""
        return F.try_element_at(F.filter("_axes", lambda x: x["name"].contains(word)), F.lit(-1))["elements"].try_cast("int")

    def corner_bound(self, bound: str) -> Column:
        """lat_min, … from the corners, where latitudes and longitudes are known, else from the label's own bounds."""
        corners = {"lat_min": F.array_min("_lats"), "lat_max": F.array_max("_lats"), "lon_min": F.array_min("_lons"), "lon_max": F.array_max("_lons")}
        return F.when((F.size("_lats") > 0) & (F.size("_lons") > 0), corners[bound]).otherwise(self.number(*C.LABEL_TAGS[f"bound_{bound}"]))


Build = Callable[[LabelText], Column]


@dataclass(frozen=True)
class LabelAdapter:
    name: str
    marks: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    #: Tags that are looked for beyond those of ``constants.LABEL_TAGS``.
    tags: tuple[str, ...] = ()
    instrument: Build | None = None
    fields: dict[str, Build] | None = None
    #: Angles of which one makes the sun's position known.
    solar: tuple[str, ...] = ANGLES

    def __post_init__(self):
        unknown = sorted(set(self.fields or {}) - set(FIELDS))
        if unknown:
            raise ValueError(f"adapter {self.name} gives unknown fields: {', '.join(unknown)}")

    def takes(self, name: Column) -> Column:
        """Whether a file of this name is this adapter's."""
        up, rules = F.upper(name), []
        if self.marks:
            rules.append(any_of([up.contains(m.upper()) for m in self.marks]))
        if self.extensions:
            rules.append(F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*self.extensions))
        return any_of(rules) if rules else F.lit(False)


def _tagged(key: str) -> Build:
    return lambda label: label.number(*C.LABEL_TAGS[key])


def _bound(key: str) -> Build:
    return lambda label: label.corner_bound(key)


def _lid(label: LabelText) -> Column:
    return label.first(*C.LABEL_TAGS["product_lid"])


def _mission(name: str) -> Build:
    return lambda label: F.lit(name)


def _camera(label: LabelText) -> Column:
    """The declared instrument, else the named one, else that of the file's name."""
    return F.coalesce(T.instrument_class(label.component("INSTRUMENT")), T.instrument_class(label.first("instrument_name", "instrument_id")),
                      T.instrument_from_name(label.file_name))


ISSDC = LabelAdapter(
    "ISSDC", marks=("OHRC", "TMC2", "TMC-2", "TMC", "IIRS", "CH2", "CHANDRAYAAN"), tags=("instrument_name", "instrument_id"), instrument=_camera,
    fields={"product_id": _lid, "mission": lambda label: F.coalesce(label.component("MISSION|INVESTIGATION"), F.lit("Chandrayaan-2")),
            "processing_level": lambda label: label.first(*C.LABEL_TAGS["processing_level"]),
            "acquisition_time": lambda label: T.iso_timestamp(label.first(*C.LABEL_TAGS["start_time"])),
            **{a: _tagged(a) for a in (*ANGLES, "spacecraft_altitude_km", "gsd_m")}, **{b: _bound(b) for b in ("lat_min", "lat_max", "lon_min", "lon_max")},
            "crs": lambda label: label.first(*C.LABEL_TAGS["crs"]), "lines": lambda label: label.axis("line"), "samples": lambda label: label.axis("sample"),
            "num_bands": lambda label: F.when(F.size("_bins") > 0, F.size("_bins")).otherwise(F.coalesce(label.axis("band"), F.lit(1))),
            "bands": lambda label: F.transform("_bins", lambda b: F.struct(inside(b, "center_wavelength").try_cast("double").alias("center_wavelength_nm"))),
            "data_type": lambda label: F.coalesce(inside(F.col("_array"), "data_type"), F.lit("unknown"))})

LROC = LabelAdapter(
    "LROC", marks=("LROC", "NAC", "M1", "M0"), tags=("resolution", "pixel_resolution"), instrument=lambda label: F.lit("LROC NAC"),
    # A label of this camera counts as known only by its incidence angle.
    solar=("incidence_angle_deg",),
    fields={"product_id": _lid, "mission": _mission("Lunar Reconnaissance Orbiter"), "gsd_m": lambda label: label.number("pixel_resolution", "resolution"),
            "sun_azimuth_deg": lambda label: label.number("sun_azimuth_angle"), "sun_elevation_deg": lambda label: label.number("sun_elevation_angle"),
            "incidence_angle_deg": lambda label: label.number("incidence_angle")})

SELENE = LabelAdapter(
    "SELENE", marks=("SELENE", "KAGUYA", "TC_", "MI_"), tags=("resolution", "pixel_resolution"),
    instrument=lambda label: F.when(F.upper(label.file_name).contains("TC"), "Terrain Camera").otherwise("Multiband Imager"),
    fields={"mission": _mission("SELENE / Kaguya"), "gsd_m": lambda label: label.number("resolution", "pixel_resolution")})

GENERIC = LabelAdapter("GENERIC", extensions=(".tif", ".tiff", ".png", ".jpg", ".jpeg", ".bmp"))

#: In the order in which they are asked.
ADAPTERS = (ISSDC, LROC, SELENE, GENERIC)


def adapter_of(name: Column, override: Column | None = None, adapters: tuple[LabelAdapter, ...] = ADAPTERS) -> Column:
    """Adapter by explicit source, else the first that takes the file name; no adapter's files are generic."""
    by_name = first_of([(a.takes(name), a.name) for a in adapters], GENERIC.name)
    return by_name if override is None else F.coalesce(override, by_name)


def tags_of(adapters: tuple[LabelAdapter, ...]) -> tuple[str, ...]:
    """Every tag that a field is read from; their texts stand in this order in ``_found``."""
    return tuple(sorted({t for tags in C.LABEL_TAGS.values() for t in tags} | {t for a in adapters for t in a.tags}
                        | {f"{c}_{axis}" for c in C.LABEL_CORNERS for axis in ("latitude", "longitude")}))


def chosen(field: str, label: LabelText, adapters: tuple[LabelAdapter, ...]) -> Column:
    """A field's expression: that of the row's adapter, null where it has none."""
    rules = [(F.col("adapter") == a.name, a.fields[field](label)) for a in adapters if a.fields and field in a.fields]
    return (first_of(rules) if rules else F.lit(None)).cast(FIELDS[field])


def instrument_of(label: LabelText, adapters: tuple[LabelAdapter, ...]) -> Column:
    rules = [(F.col("adapter") == a.name, a.instrument(label)) for a in adapters if a.instrument]
    return first_of(rules) if rules else F.lit(None).cast("string")


def solar_known(adapters: tuple[LabelAdapter, ...]) -> Column:
    """Whether one of the angles that count for the row's adapter is known."""
    any_known = lambda names: any_of([F.col(n).isNotNull() for n in names])
    rules = [(F.col("adapter") == a.name, any_known(a.solar)) for a in adapters if a.solar != ANGLES]
    return first_of(rules, any_known(ANGLES)) if rules else any_known(ANGLES)
