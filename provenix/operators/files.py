"""From decoded files to analyzed records: the columns of the evidence view, timestamps of all nine sources, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.functions import geo, time
from provenix.operators import rules
from provenix.plans import evidence
from provenix.sources.xmp import CAMERA

TIFF, _, AUX = CAMERA


def _camera(ns: str, name: str) -> Column:
    return F.try_element_at(F.col("xmp.exif_in_xmp"), F.lit(f"{ns}#{name}"))


def other_claims() -> dict[str, Column]:
    """Claims beside those of capture time, named so that they sort with those as their sources do; the last is the file's own time, which is no image metadata."""
    c = F.col
    clock = [F.get("gps_time", i) for i in range(3)]
    return {
        "t_2": time.normalize_exif(c("datetime_digitized"), c("offset_time_digitized"), "digitized", "EXIF DateTimeDigitized"), "t_3": time.normalize_exif(c("datetime_file"), c("offset_time"), "file", "EXIF DateTime"),
        "t_5": time.normalize_xmp(c("xmp.modify_date"), "modified", "XMP xmp:ModifyDate"), "t_7": time.normalize_gps(c("gps_date"), *clock), "t_8": time.normalize_icc(c("icc.created")), "t_9": time.normalize_mtime(c("mtime")),
    }


def observed(files: DataFrame) -> DataFrame:
    """Decoded rows with the evidence view's names beside their own; absent lists are empty."""
    c = F.col
    return files.withColumns({
        "filename": F.substring_index("path", "/", -1), "exif_raw": c("datetime_original"), "offset_raw": c("offset_time_original"), "xmp_raw": c("xmp.create_date"), "iptc_date": c("iptc.date_created_raw"),
        "iptc_time": c("iptc.time_created_raw"), "make_raw": c("make"), "model_raw": c("model"), "software_raw": c("software"), "xmp_make_raw": _camera(TIFF, "Make"), "xmp_model_raw": _camera(TIFF, "Model"),
        "xmp_tool_raw": c("xmp.creator_tool"), "has_gps": c("lat").isNotNull() & c("lon").isNotNull(), "gps_valid": F.coalesce(c("lat").between(-90, 90) & c("lon").between(-180, 180), F.lit(False)),
        "altitude": geo.altitude(c("gps_altitude"), F.coalesce("gps_altitude_ref", F.lit(0))), "bearing": geo.bearing(c("gps_direction")), "caption": c("iptc.caption"), "title": c("xmp.title"),
        "keywords": F.coalesce("iptc.keywords", F.array().cast("array<string>")), "aux_serial": _camera(AUX, "SerialNumber"), "thumb_claimed": F.coalesce("thumbnail_claimed", F.lit(False)), "thumbnail_count": F.coalesce(F.array_size("thumbnails"), F.lit(0)), "thumbs": thumbs(),
        "warning_count": sum((F.coalesce(F.array_size(n), F.lit(0)) for n in ("xmp.warnings", "iptc.warnings", "icc.warnings")), F.coalesce(F.array_size("warnings"), F.lit(0))),
    })


def thumbs() -> Column:
    """The thumbnails with their comparison to the image; none is an empty array."""
    c = F.col

    def of(t: Column) -> Column:
        compared = rules.compare_thumbnail(t["width"], t["height"], c("width"), c("height"), t["dqt"], t["dht"], c("main_dqt"), c("main_dht"))
        return F.struct(*(t[n].alias(n) for n in ("index", "source", "width", "height", "sha256", "dqt", "dht")), *(compared[n].alias(n) for n in ("larger", "aspect", "off", "scale", "encoder")))

    return F.transform(F.coalesce("thumbnails", F.expr("cast(array() as array<struct<index:bigint,source:string,byte_size:bigint,sha256:string,width:bigint,height:bigint,format:string,dqt:bigint,dht:boolean>>)")), of)


def analyze(files: DataFrame, tolerance_s: float = rules.TOLERANCE_S) -> DataFrame:
    """Decoded files with timestamps, claims, comparison, device, day, flags and the ids of the rules that raised them. A file with an instant that can't be counts as failed."""
    a = evidence.flagged(evidence.analyzed(observed(files), other_claims()), tolerance_s)
    impossible = (F.col("status") == "ok") & F.col("failed")
    a = a.withColumns({"status": F.when(impossible, "error").otherwise(F.col("status")), "error": F.when(impossible, "a timestamp's offset asks for an instant that doesn't exist").otherwise(F.col("error"))})
    return a.withColumns({"anomaly_rule_ids": evidence.rule_ids(), "evidence_id": F.concat(F.lit("MT-"), F.substring("sha256", 1, 16))})
