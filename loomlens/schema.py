"""Schemas of the tables the engine owns. Rows are identified by obs_id, never by position."""

from pyspark.sql import types as T

INDEX = T.StructType([T.StructField("obs_id", T.LongType()), T.StructField("partition", T.StringType()), T.StructField("sample_weight", T.DoubleType())])
CONCEPT = T.StructType([T.StructField("concept", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("is_risk_factor", T.BooleanType()), T.StructField("prior", T.DoubleType())])
SECTION = T.StructType([T.StructField("obs_id", T.LongType()), T.StructField("section_id", T.IntegerType()), T.StructField("section", T.StringType())])
ANNOTATION = T.StructType([T.StructField("obs_id", T.LongType()), T.StructField("concept_id", T.IntegerType()), T.StructField("answer", T.DoubleType())])
HISTORY_ITER = T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("iter", T.IntegerType()), T.StructField("phase", T.StringType()), T.StructField("auc", T.DoubleType()), T.StructField("test_auc", T.DoubleType()), T.StructField("log_lik", T.DoubleType()), T.StructField("intercept", T.DoubleType())])
HISTORY_COEF = T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("iter", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("concept", T.StringType()), T.StructField("coef", T.DoubleType())])
EVIDENCE = T.StructType([T.StructField("obs_id", T.LongType()), T.StructField("evidence", T.MapType(T.StringType(), T.StringType()))])
SPAN = T.StructType([T.StructField("span", T.StringType()), T.StructField("date", T.StringType()), T.StructField("loc", T.StringType())])
CARD = T.StructType(
    [
        T.StructField("concept", T.StringType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("rubric", T.StructType([T.StructField("positive", T.ArrayType(T.StringType())), T.StructField("negative", T.ArrayType(T.StringType()))])),
        T.StructField("evidence", T.ArrayType(SPAN)),
        T.StructField("derived", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("prior", T.DoubleType()),
    ]
)
RESPONSE = T.StructType([T.StructField("question", T.LongType()), T.StructField("answer", T.DoubleType())])
LINKAGE = T.ArrayType(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("size", T.IntegerType())]))
VALUE_TYPES = ("binary", "categorical", "ordinal", "count", "duration_days")
