"""IPTC: the record in a JPEG's Photoshop resources, its datasets and their fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

from provenix.sources.containers import jpeg_segments

#: The segment's header, the record's resource, and the fields of record 2 by dataset.
HEADER, RESOURCE = b"Photoshop 3.0\0", 0x0404
ONE = {5: "object_name", 15: "category", 40: "special_instructions", 55: "date_created_raw", 60: "time_created_raw", 90: "city", 92: "sublocation", 95: "province_state", 100: "country_code", 101: "country", 105: "headline", 115: "source", 120: "caption", 122: "caption_writer"}
MANY = {20: "supplemental_categories", 25: "keywords", 80: "byline", 85: "byline_title", 110: "credit", 116: "copyright_notice"}


def resources(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, payload) of 8BIM blocks; names and payloads are padded to even lengths. Damage is a ValueError."""
    at = 0
    while at + 12 <= len(body):
        after = at + 6 + (body[at + 6] + 2) // 2 * 2
        size = int.from_bytes(body[after : after + 4], "big")
        if body[at : at + 4] != b"8BIM" or after + 4 + size > len(body):
            raise ValueError(f"no whole 8BIM block at {at}")
        yield int.from_bytes(body[at + 4 : at + 6], "big"), body[after + 4 : after + 4 + size]
        at = after + 4 + size + size % 2


def record(data: bytes) -> bytes | None:
    """The first record of a JPEG; None where a block before it is damaged."""
    try:
        return next((p for m, s in jpeg_segments(data) if m == 0xED and s.startswith(HEADER) for r, p in resources(s[len(HEADER) :]) if r == RESOURCE), None)
    except ValueError:
        return None


def datasets(data: bytes) -> tuple[list[tuple[int, int, bytes]], list[str]]:
    """(record, dataset, value) up to damage, and warnings. A length with its top bit set counts the bytes of the length that follows."""
    out: list[tuple[int, int, bytes]] = []
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at + 3 : at + 5], "big")
        wide = size & 0x7FFF if size & 0x8000 else 0
        start = at + 5 + wide
        if wide:
            size = int.from_bytes(data[at + 5 : start], "big")
        if data[at] != 0x1C or start > len(data) or wide > 4 or size == 0x8000 and not wide or start + size > len(data):
            return out, [f"IPTC is damaged at byte {at}; {len(out)} datasets before it are kept"]
        out.append((data[at + 1], data[at + 2], data[start : start + size]))
        at = start + size
    return out, []


def text(value: bytes) -> str:
    try:
        return value.decode()
    except UnicodeDecodeError:
        return value.decode("latin-1")


def shown_date(raw: str | None) -> str | None:
    """YYYYMMDD as YYYY-MM-DD; None if it can't be a date."""
    m = re.fullmatch(r"([0-9]{4})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])", raw or "")
    return "-".join(m.groups()) if m else None


def shown_time(raw: str | None) -> str | None:
    """HHMMSS and an offset as HH:MM:SS+HH:MM; what follows the seconds and is no offset is left out."""
    m = re.match(r"([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9]|6[01])(?:([+-][0-9]{2})([0-9]{2})\Z)?", raw or "")
    return f"{m[1]}:{m[2]}:{m[3]}" + (f"{m[4]}:{m[5]}" if m[4] else "") if m else None


def decode(fmt: str, data: bytes) -> dict | None:
    """The fields of a JPEG's record; None without one. Of a field that can't repeat the first counts, ``raw`` keeps all."""
    found = record(data) if fmt == "JPEG" else None
    if found is None:
        return None
    sets, warnings = datasets(found)
    if not sets and not warnings:
        return None
    out: dict = {name: [text(v) for r, d, v in sets if (r, d) == (2, key)] for key, name in MANY.items()}
    out |= {name: next((text(v) for r, d, v in sets if (r, d) == (2, key)), None) for key, name in ONE.items()}
    out |= {"date_created": shown_date(out["date_created_raw"]), "time_created": shown_time(out["time_created_raw"])}
    version = next((v for r, d, v in sets if (r, d) == (2, 0)), b"")
    if len(version) not in (0, 2):
        warnings.append(f"IPTC record version has {len(version)} bytes")
    out["record_version"] = int.from_bytes(version, "big") if len(version) == 2 else None
    out["raw"] = [{"record": r, "dataset": d, "value": text(v), "hex": v.hex()} for r, d, v in sets]
    return out | {"warnings": warnings}
