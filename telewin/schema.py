"""Record shapes every transform works on.

An observation row is ``key, value, part, off``: the message key, the nested
reading, the source partition and the arrival offset inside that partition.
Unions are structs with one nullable member per branch. Records may carry
further fields; transforms keep them untouched.
"""

from pyspark.sql import types as T

KEY = T.StructType([T.StructField("ep", T.StringType())])

READING = T.StructType(
    [
        T.StructField("lng", T.LongType()),
        T.StructField("dbl", T.DoubleType()),
    ]
)

RESOURCE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("value", READING),
    ]
)

BODY = T.StructType([T.StructField("content", RESOURCE)])

RESPONSE = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("rep", T.StructType([T.StructField("body", BODY)])),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("key", KEY),
        T.StructField("value", RESPONSE),
        T.StructField("part", T.IntegerType()),
        T.StructField("off", T.LongType()),
    ]
)
