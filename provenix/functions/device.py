"""Device claims: observed maker, model and software next to display forms and comparison keys."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenix.functions.text import CORPORATE, collapse, comparison_key, given, inline, strip

#: Makers by their upper-case name without spaces and hyphens, and how they are shown.
MAKES = {
    "CANON": "Canon", "NIKON": "Nikon", "SONY": "Sony", "FUJIFILM": "Fujifilm", "FUJI": "Fujifilm", "PANASONIC": "Panasonic", "OLYMPUS": "Olympus", "OMSYSTEM": "OM System",
    "LEICA": "Leica", "APPLE": "Apple", "SAMSUNG": "Samsung", "GOOGLE": "Google", "HUAWEI": "Huawei", "XIAOMI": "Xiaomi", "HASSELBLAD": "Hasselblad", "PENTAX": "Pentax",
    "RICOH": "Ricoh", "DJI": "DJI", "GOPRO": "GoPro", "KODAK": "Kodak", "SIGMA": "Sigma", "TAMRON": "Tamron", "ONEPLUS": "OnePlus", "MOTOROLA": "Motorola", "LG": "LG",
    "SONYERICSSON": "Sony Ericsson",
}
EXIF_SOURCE, XMP_SOURCE = "EXIF", "XMP tiff:Make/tiff:Model"
UNKNOWN_DEVICE = "unknown device"


def make_base(raw: Column) -> Column:
    return strip(F.regexp_replace(collapse(raw), CORPORATE, ""))


def normalize_make(raw: Column, keep: Callable = inline) -> tuple[Column, Column]:
    """(display, key): known makers in their usual spelling, others as observed."""
    base = keep(make_base(raw), 0)
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MAKES.items()))
    return keep(F.coalesce(F.try_element_at(known, F.regexp_replace(F.upper(base), "[ -]", "")), base), 1), keep(comparison_key(base), 1)


def normalize_model(raw: Column, make: Column, make_key: Column, keep: Callable = inline) -> tuple[Column, Column]:
    """(display, key): the maker is put in front unless the model names it already."""
    clean = keep(collapse(raw), 0)
    key = keep(comparison_key(clean), 1)
    display = keep(F.when(make.isNotNull() & make_key.isNotNull() & key.isNotNull() & ~F.startswith(key, make_key), F.concat_ws(" ", make, clean)).otherwise(clean), 2)
    return display, comparison_key(display)


def normalize_software(raw: Column, keep: Callable = inline) -> tuple[Column, Column]:
    clean = keep(collapse(raw), 0)
    return clean, comparison_key(clean)


def device_claim(source: str, make_raw: Column, model_raw: Column, software_raw: Column, keep: Callable = inline) -> Column:
    """The claim of one source; null if all it has is empty."""
    make, make_key = normalize_make(make_raw, keep)
    model, model_key = normalize_model(model_raw, make, make_key, keep)
    software, software_key = normalize_software(software_raw, keep)
    return F.when(given(make_raw) | given(model_raw) | given(software_raw), F.struct(
        F.lit(source).alias("source"), make_raw.alias("make_raw"), model_raw.alias("model_raw"), software_raw.alias("software_raw"), make.alias("make_norm"), model.alias("model_norm"),
        software.alias("software_norm"), make_key.alias("make_key"), model_key.alias("model_key"), software_key.alias("software_key"),
    ))


def key_and_display(c: Column) -> tuple[Column, Column]:
    """Device group of a file from its preferred claim; a claim of software alone is unknown."""
    some = F.coalesce(c["make_key"], c["model_key"]).isNotNull()
    key = F.concat(F.coalesce(c["make_key"], F.lit("?")), F.lit("/"), F.coalesce(c["model_key"], F.lit("?")))
    shown = F.coalesce(c["model_norm"], F.concat(c["make_norm"], F.lit(" (model unknown)")))
    return F.when(some, key).otherwise("unknown"), F.when(some, shown).otherwise(UNKNOWN_DEVICE)
