"""XMP: finding the packet in a container, and its RDF as namespaces, names and values."""

from __future__ import annotations

import json
import zlib
from xml.etree import ElementTree

from provenix.sources.containers import jpeg_segments, png_chunks, webp_chunks
from provenix.sources.tiff import Directories

#: Most bytes of a packet that are parsed.
MOST = 4 << 20
#: What marks a packet in JPEG and PNG, its TIFF tag, and the namespaces.
JPEG_HEADER, PNG_KEYWORD, TIFF_TAG = b"http://ns.adobe.com/xap/1.0/\0", b"XML:com.adobe.xmp", 700
RDF, DC, BASIC, PHOTOSHOP = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/dc/elements/1.1/", "http://ns.adobe.com/xap/1.0/", "http://ns.adobe.com/photoshop/1.0/"
CAMERA = ("http://ns.adobe.com/tiff/1.0/", "http://ns.adobe.com/exif/1.0/", "http://ns.adobe.com/exif/1.0/aux/")
LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def inflate(data: bytes, most: int, whole: bool = False) -> bytes | None:
    """Inflated bytes, one more than ``most`` at the largest; None of damaged data, and with ``whole`` of cut data."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, most + 1)
    except zlib.error:
        return None
    return None if whole and not stream.eof and len(out) <= most else out


def _itxt(chunk: bytes) -> bytes | None:
    keyword, _, rest = chunk.partition(b"\0")
    parts = rest[2:].split(b"\0", 2)  # language, translated keyword, text
    if keyword != PNG_KEYWORD or len(parts) < 3:
        return None
    if not rest[0]:
        return parts[2]
    return inflate(parts[2], MOST, whole=True) if rest[1] == 0 else None


def packet(fmt: str, data: bytes) -> bytes | None:
    """The first packet of a file."""
    if fmt == "JPEG":
        return next((p[len(JPEG_HEADER) :] for m, p in jpeg_segments(data) if m == 0xE1 and p.startswith(JPEG_HEADER)), None)
    if fmt == "PNG":
        return next((t for k, p in png_chunks(data) if k == b"iTXt" and (t := _itxt(p)) is not None), None)
    if fmt == "WEBP":
        return next((p for k, p in webp_chunks(data) if k == b"XMP "), None)
    return Directories(data).blob(TIFF_TAG) if fmt == "TIFF" else None


def _name(tag: str) -> tuple[str, str]:
    ns, _, local = tag.removeprefix("{").rpartition("}")
    return ns, local


def _value(e: ElementTree.Element) -> object:
    """A property's text, list (Bag, Seq), preferred text (Alt) or names to values; None if empty."""
    kids = [(*_name(k.tag), k) for k in e]
    if len(kids) == 1 and kids[0][0] == RDF and kids[0][1] in ("Alt", "Bag", "Seq"):
        items = [(li.get(LANG), t) for li in kids[0][2] if _name(li.tag)[1] == "li" and (t := (li.text or "").strip())]
        texts = [t for _, t in items]
        if kids[0][1] != "Alt":
            return texts or None
        return ([t for lang, t in items if lang == "x-default"][-1:] or texts[:1] or [None])[0]
    nested = {local: _value(k) for ns, local, k in reversed(kids) if ns != RDF}  # of a repeated name the first counts
    return dict(reversed(nested.items())) or (e.text or "").strip() or None


def properties(text: str) -> tuple[dict[str, dict[str, object]], list[str]]:
    """Namespace to name to value, and warnings; attributes overwrite, of repeated elements the first counts."""
    if "<!ENTITY" in text or "<!DOCTYPE" in text:
        return {}, ["XMP declares entities or a document type; not parsed"]
    out: dict[str, dict[str, object]] = {}
    try:
        todo = [ElementTree.fromstring(text)]
        while todo:
            e = todo.pop()
            if _name(e.tag) == (RDF, "Description"):
                for key, value in e.attrib.items():
                    ns, local = _name(key)
                    if ns not in (RDF, "") and local != "about":
                        out.setdefault(ns, {})[local] = value
                for p in e:
                    ns, local = _name(p.tag)
                    if ns not in (RDF, ""):
                        out.setdefault(ns, {}).setdefault(local, _value(p))
            todo.extend(k for k in reversed(e) if _name(k.tag) in ((RDF, "RDF"), (RDF, "Description")))
    except (ElementTree.ParseError, ValueError, RecursionError) as e:
        return out, [f"XMP is malformed: {type(e).__name__}"]
    return out, []


def _text(value: object) -> str | None:
    """A text, or the first of a list."""
    return next((x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str) and x), None)


def _texts(value: object) -> list[str]:
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value]) if x is not None]


def _shown(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


def _rating(value: object) -> int | None:
    try:
        n = int(str(value))
    except ValueError:
        return None
    return n if abs(n) < 1 << 63 else None


def decode(fmt: str, data: bytes, most: int = MOST) -> dict | None:
    """The views of a file's packet; None without one. Lists and nested values of the maps are JSON."""
    found = packet(fmt, data)
    if found is None:
        return None
    warnings = [f"XMP is longer than {most} bytes; cut"] if len(found) > most else []
    raw = found[:most].decode("utf-8", "replace")
    known, more = properties(raw)
    dc, basic, ps = (known.get(ns, {}) for ns in (DC, BASIC, PHOTOSHOP))
    return {
        "packet": raw, "truncated": len(found) > most, "namespaces": sorted(known),
        "title": _text(dc.get("title")), "creator": _texts(dc.get("creator")), "description": _text(dc.get("description")), "rights": _text(dc.get("rights")), "subject": _texts(dc.get("subject")),
        "create_date": _text(basic.get("CreateDate")), "modify_date": _text(basic.get("ModifyDate")), "creator_tool": _text(basic.get("CreatorTool")), "rating": _rating(basic.get("Rating")),
        "authors_position": _text(ps.get("AuthorsPosition")), "credit": _text(ps.get("Credit")), "source": _text(ps.get("Source")), "date_created": _text(ps.get("DateCreated")),
        "exif_in_xmp": [(f"{ns}#{k}", _shown(v)) for ns in CAMERA for k, v in known.get(ns, {}).items()],
        "properties": [(f"{ns}#{k}", _shown(v)) for ns, names in known.items() for k, v in names.items()],
        "warnings": warnings + more,
    }
