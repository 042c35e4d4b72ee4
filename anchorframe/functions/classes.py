"""Drought class lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published class labels. On the dry side a class holds values up to and including its
# bound; on the wet side it starts at its bound. So no value falls between two classes.
PDSI_DRY = [
    (-5.0, "extreme drought"), (-4.0, "severe drought"), (-3.0, "moderate drought"),
    (-2.0, "mild drought"), (-1.0, "incipient dry spell"),
]
PDSI_WET = [
    (5.0, "extremely wet"), (4.0, "very wet"), (3.0, "moderately wet"), (2.0, "slightly wet"),
    (1.0, "incipient wet spell"),
]
SPEI_DRY = [
    (-2.0, "extreme drought"), (-1.6, "severe drought"), (-1.3, "moderate drought"),
    (-0.8, "mild drought"), (-0.5, "incipient dry spell"),
]
SPEI_WET = [
    (2.0, "extremely wet"), (1.6, "very wet"), (1.3, "moderately wet"), (0.8, "slightly wet"),
    (0.5, "incipient wet spell"),
]
SCALES = {"pdsi": (PDSI_DRY, PDSI_WET), "spei": (SPEI_DRY, SPEI_WET)}


def drought_class(c: str | Column, scale: str) -> Column:
    """Class of a drought index: 11 classes for ``pdsi`` and ``spei``, 3 for ``pdsi_zone``."""
    x = F.col(c) if isinstance(c, str) else c
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
    if scale == "pdsi_zone":
        return out.when(x <= -4, "Extreme Drought").when(x < 0, "Drought").otherwise("wet")
    dry, wet = SCALES[scale]
    for bound, label in dry:
        out = out.when(x <= F.lit(bound), label)
    for bound, label in wet:
        out = out.when(x >= F.lit(bound), label)
    return out.otherwise("near normal")
