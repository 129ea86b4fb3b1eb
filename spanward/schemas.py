"""Table schemas. Offsets count characters (code points), 0-based and half-open."""

from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("value", T.StringType()),
    ]
)
ENTITIES = T.ArrayType(ENTITY)
ENTITIES_DDL = "array<struct<label:string,start:int,end:int,score:double,value:string>>"

SAMPLES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("style", T.StringType()),
        T.StructField("is_hard_negative", T.BooleanType()),
        T.StructField("entities", ENTITIES),
    ]
)

ENDPOINTS = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("rpm", T.LongType()),
        T.StructField("tpm", T.LongType()),
        T.StructField("tpr", T.LongType()),
        T.StructField("cost_per_million", T.DoubleType()),
        T.StructField("complexity_tier", T.StringType()),
    ]
)
FALLBACKS = T.StructType(
    [
        T.StructField("cluster", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("fallback", T.StringType()),
    ]
)
USAGE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("tokens", T.LongType()),
    ]
)
POLICY = T.StructType([T.StructField("label", T.StringType()), T.StructField("action", T.StringType())])
SAFETY_RULES = T.StructType(
    [
        T.StructField("guard", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
VOCAB = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("tag", T.StringType())])
