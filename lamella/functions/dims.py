"""Fixed tables of the image formats."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# DICOM transfer syntaxes with their names and TIFF compression tags (DICOM PS3.6; TIFF tag 259).
TRANSFER_SYNTAXES = [
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline", 7),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended Sequential", 7),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless", 7),
    ("1.2.840.10008.1.2.4.70", "JPEG Lossless Non-Hierarchical", 7),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless", 34892),
    ("1.2.840.10008.1.2.4.81", "JPEG-LS Near-Lossless", 34892),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Lossless", 34712),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000", 34712),
    ("1.2.840.10008.1.2.4.92", "JPEG 2000 Part 2 Multicomponent Lossless", 34712),
    ("1.2.840.10008.1.2.4.93", "JPEG 2000 Part 2 Multicomponent", 34712),
]
#: Any other syntax keeps the tag that files of this kind have always been given.
UNKNOWN_SYNTAX = ("Unknown/Uncompressed", 34712)
WSI_CLASS, WSI_MODALITY = "1.2.840.10008.5.1.4.1.1.77.1.6", "SM"
JPEG_TAG, JP2K_CODES = 7, (33003, 33005, 34712)
#: Syntaxes whose decoders halve exactly: JPEG Baseline and Extended, and JPEG 2000.
EXACT_HALVING = [u for u, _, _ in TRANSFER_SYNTAXES if u[-2:] in ("50", "51", "90", "91", "92", "93")]
JPEG2000 = [u for u, _, _ in TRANSFER_SYNTAXES if u[-2:] in ("90", "91", "92", "93")]
# Photometric interpretations and the colour space of their decoded pixels.
PHOTOMETRIC = {"RGB": "RGB", "YBR_ICT": "RGB", "YBR_RCT": "RGB", "YBR_FULL": "YCbCr", "YBR_FULL_422": "YCbCr", "MONOCHROME1": "Grayscale", "MONOCHROME2": "Grayscale"}
# Micrometres in a unit. Both code points of the micro sign occur.
UNIT_UM = {"µm": 1.0, "μm": 1.0, "um": 1.0, "micron": 1.0, "nm": 0.001, "mm": 1000.0, "cm": 10000.0, "m": 1000000.0}


def lookup(column: Column, pairs: dict) -> Column:
    """pairs[column], else null: a constant map, so no join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())]), column)


def compression_name(uid: Column) -> Column:
    return F.coalesce(lookup(uid, {u: n for u, n, _ in TRANSFER_SYNTAXES}), F.lit(UNKNOWN_SYNTAX[0]))


def compression_tag(uid: Column) -> Column:
    return F.coalesce(lookup(uid, {u: t for u, _, t in TRANSFER_SYNTAXES}), F.lit(UNKNOWN_SYNTAX[1]))


def syntax_values_sql() -> str:
    return ", ".join(f"('{u}', '{n}', {t})" for u, n, t in TRANSFER_SYNTAXES)
