"""Declared schemas. Nothing in the package infers one."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), True)

SNAPSHOT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.DoubleType()),
])

STORE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("vector", VECTOR),
    T.StructField("error", T.StringType()),
])

# In the files of a store: its rows with the version that wrote them, and what hides older rows.
STORED = T.StructType([*STORE.fields, T.StructField("version", T.LongType())])
TOMBSTONE = T.StructType([T.StructField("path", T.StringType()), T.StructField("version", T.LongType())])

LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("is_dir", T.BooleanType()),
])
