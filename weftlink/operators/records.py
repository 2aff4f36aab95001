"""The record model: schema, normalised records and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions import text as X

COLUMNS = ("entity_id", "business_name", "business_address", "country")
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def preprocess(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Records with twelve normalised columns; the originals stay, and nothing is null."""
    name, place = F.col("business_name"), F.col("business_address")
    plain = {
        "name_norm": X.business_name(X.normalize_text(name, ascii_only)),
        "address_norm": X.address(X.normalize_text(place, ascii_only)),
        "country_norm": X.normalize_text(F.col("country"), ascii_only),
    }
    return df.withColumns(plain | X.address_parts(place, ascii_only) | X.contacts(F.concat_ws(" ", name, place)))


def source_of(entity_id: Column) -> Column:
    """1, 2 or 3 from the id's prefix."""
    return F.substring(entity_id, 2, 1).cast("int")


def problems(df: DataFrame, source: int) -> DataFrame:
    """(problem, n): what breaks the rules for ids of a source; no rows if nothing does."""
    e = F.col("entity_id")
    each = {
        "blank id": F.coalesce(F.trim(e), F.lit("")) == "",
        "wrong prefix": ~e.startswith(f"S{source}-") | (F.length(e) <= 3),
        "comma or blank in id": e.rlike(r"[,\s]"),
    }
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in each.items()], (F.count("entity_id") - F.count_distinct("entity_id")).alias("repeated id"))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counts.columns)), F.array(*[F.col(f"`{c}`") for c in counts.columns])))).toDF("problem", "n").where("n > 0")
