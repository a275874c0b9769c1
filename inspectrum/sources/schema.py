"""Schemas. Raw columns are all strings: nothing is inferred, casts are explicit."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the yearly inspection files, in file order.
RAW_COLUMNS = [
    "TEHNOYLEVAATUSPUNKT",
    "PUNKTI_KOOD",
    "TOOTAJA",
    "YV_KUUPAEV",
    "YLEVAATUSLIIK",
    "YLEVAATUSOTSUS",
    "RIKKED",
    "SOIDUK_ID",
    "ESMANE_REG_AASTA",
    "MARK",
    "MUDEL",
    "KATEGOORIA",
    "KERETYYP",
]

# Column names of the defect-code file.
DIMENSION_COLUMNS = [
    "ID",
    "NIMETUS",
    "TYYP",
    "RIKKE_LIIK",
    "VANEM_ID",
    "VO",
    "OV",
    "EOV",
    "KUVAMISE_JARJEKORD",
    "ALGUS",
    "LOPP",
    "KOOD",
    "KEHTIV_RIKE_ID",
]

YEAR = "ALLIKA_AASTA"
ROW_NO = "RIDA_NR"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
DIMENSION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in DIMENSION_COLUMNS])
LANDED_SCHEMA = T.StructType(
    [*RAW_SCHEMA.fields, T.StructField(ROW_NO, T.LongType()), T.StructField(YEAR, T.IntegerType())]
)
