"""Text as terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: letters and numbers other than decimal digits, which is what the reference's tokens are.
TERM = r"[\p{L}\p{Nl}\p{No}]+"


def terms(text: Column) -> Column:
    """The runs of letters of the text in lower case; digits, underscores and signs split; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def title_and_abstract() -> Column:
    """Title, a space and abstract, null read as empty."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
