"""Schemas of the statement tables."""

from pyspark.sql import types as T

_PAGE = [T.StructField("doc_id", T.StringType()), T.StructField("page_no", T.IntegerType())]
_BOX = [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
MONEY = T.DecimalType(18, 2)

SPANS = T.StructType([*_PAGE, T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType()), *_BOX])
PAGES = T.StructType([*_PAGE, T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])
REDACTIONS = T.StructType([*_PAGE, T.StructField("seq", T.IntegerType()), *_BOX, T.StructField("reason", T.StringType())])
#: findings never carry the matched text
FINDINGS = T.StructType([*_PAGE, T.StructField("entity_type", T.StringType()), T.StructField("score", T.DoubleType()), *_BOX])
CONTACT = T.StructType([*[T.StructField(c, T.StringType(), False) for c in ("id", "name", "email", "project_type", "details")], T.StructField("created_at", T.TimestampType(), False)])
