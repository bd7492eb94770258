"""OME-XML descriptions as columns, and the same text for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.functions.scalars import ome_type, xml_attribute_replaced, xml_escape

_NS = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
_HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<OME xmlns="{_NS}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="{_NS} {_NS}/ome.xsd">\n'
#: Parts of a description: literal texts and names of values. No name or identifier of a patient or series is among them.
_PIXELS = ['<Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="', "type", '" SizeX="', "w", '" SizeY="', "h", '" SizeZ="1" SizeC="', "c", '" SizeT="1" PhysicalSizeX="', "x", '" PhysicalSizeXUnit="µm" PhysicalSizeY="', "y", '" PhysicalSizeYUnit="µm" Interleaved="', "interleaved", '">']
_DICOM = [_HEAD, "instrument", '<Image ID="Image:0">\n', "reference", *_PIXELS, '<Channel ID="Channel:0:0" SamplesPerPixel="', "c", '"><LightPath/></Channel><TiffData FirstC="0" FirstT="0" FirstZ="0" IFD="0" PlaneCount="1"/></Pixels></Image></OME>']
_TIFF = [_HEAD, '<Image ID="Image:0" Name="', "name", '">\n', *_PIXELS, '<Channel ID="Channel:0:0" SamplesPerPixel="', "c", '"/><TiffData/></Pixels></Image></OME>']
_NAMES = {"type", "w", "h", "c", "x", "y", "interleaved", "instrument", "reference", "name"}


def _fill(parts: list[str], values: dict) -> Column:
    return F.concat(*(values[p] if p in _NAMES else F.lit(p) for p in parts))


def _size(mpp: Column) -> Column:
    """Six decimals, by decimal arithmetic."""
    return F.round(mpp.cast("decimal(30,12)"), 6).cast("decimal(24,6)").cast("string")


def _common(w: Column, h: Column, x: Column, y: Column, c: Column, bits: Column) -> dict:
    return {"type": ome_type(bits), "w": w.cast("string"), "h": h.cast("string"), "c": c.cast("string"), "x": _size(x), "y": _size(y)}


def dicom_xml(w: Column, h: Column, mpp_x: Column, mpp_y: Column, bits: Column, samples: Column, maker: Column) -> Column:
    """Of a DICOM pyramid; an unknown resolution is 0.25, and the maker is the only text taken over."""
    x = F.coalesce(mpp_x, F.lit(0.25))
    color = samples >= 3
    values = _common(F.coalesce(w, F.lit(0)), F.coalesce(h, F.lit(0)), x, F.coalesce(mpp_y, x), F.when(color, samples).otherwise(1), bits)
    maker = F.nullif(F.trim(maker), F.lit(""))
    made = F.concat(F.lit('<Instrument ID="Instrument:0"><Microscope Manufacturer="'), xml_escape(maker), F.lit('"/></Instrument>\n'))
    values |= {"interleaved": F.when(color, "true").otherwise("false"), "instrument": F.coalesce(made, F.lit("")), "reference": F.when(maker.isNotNull(), '<InstrumentRef ID="Instrument:0"/>').otherwise("")}
    return _fill(_DICOM, values)


def tiff_xml(name: Column, w: Column, h: Column, mpp_x: Column, mpp_y: Column, samples: Column) -> Column:
    values = _common(w, h, mpp_x, mpp_y, samples, F.lit(8)) | {"name": xml_escape(name), "interleaved": F.when(samples >= 3, "true").otherwise("false")}
    return _fill(_TIFF, values)


def updated_xml(xml: Column, w: Column, h: Column, mpp_x: Column, mpp_y: Column) -> Column:
    """A description with the output's sizes; the rest stays."""
    for name, value in (("SizeX", w.cast("string")), ("SizeY", h.cast("string")), ("PhysicalSizeX", _size(mpp_x)), ("PhysicalSizeY", _size(mpp_y)), ("PhysicalSizeXUnit", F.lit("µm")), ("PhysicalSizeYUnit", F.lit("µm")), ("IFD", F.lit("0"))):
        xml = xml_attribute_replaced(xml, name, value)
    return xml


def _sql(parts: list[str], values: dict) -> str:
    return " || ".join(values[p] if p in _NAMES else "'" + p.replace("'", "''") + "'" for p in parts)


_SQL = {"w": "w::VARCHAR", "h": "h::VARCHAR", "x": "mpp::DECIMAL(24,6)::VARCHAR", "y": "mpp::DECIMAL(24,6)::VARCHAR", "c": "spp::VARCHAR", "interleaved": "CASE WHEN spp >= 3 THEN 'true' ELSE 'false' END"}


def dicom_xml_sql() -> str:
    maker = "replace(replace(replace(maker || ' & <co>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return _sql(_DICOM, _SQL | {"type": "CASE k WHEN 1 THEN 'uint16' ELSE 'uint8' END", "instrument": f"CASE WHEN k <> 0 THEN '<Instrument ID=\"Instrument:0\"><Microscope Manufacturer=\"' || {maker} || '\"/></Instrument>' || chr(10) ELSE '' END", "reference": "CASE WHEN k <> 0 THEN '<InstrumentRef ID=\"Instrument:0\"/>' ELSE '' END"})


def tiff_xml_sql() -> str:
    return _sql(_TIFF, _SQL | {"type": "'uint8'", "name": "maker || ' &quot;a&amp;b&quot;'"})
