"""Explicit schemas of everything that enters or leaves the engine."""

from pyspark.sql import types as T

_s = lambda name, kind=T.StringType(), null=True: T.StructField(name, kind, null)

NOTE = T.StructType([_s("path"), _s("title"), _s("text"), _s("tags", T.ArrayType(T.StringType()))])
FRAGMENT = T.StructType([_s("heading"), _s("text"), _s("start_line", T.IntegerType())])
HIT = T.StructType([_s("path"), _s("title"), _s("heading"), _s("text"), _s("start_line", T.IntegerType()), _s("score", T.DoubleType()), _s("id")])
QUERY = T.StructType([_s("key"), _s("kind"), _s("query")])
RELEVANCE = T.StructType([_s("key"), _s("path"), _s("grade", T.IntegerType())])
JUDGEMENT = T.StructType([_s("scores", T.ArrayType(T.DoubleType())), _s("input_tokens", T.LongType()), _s("cost", T.DoubleType()), _s("error")])
CHANGE = T.StructType([_s("stamp", T.LongType()), _s("kind"), _s("path"), _s("old_path"), _s("mtime", T.LongType()), _s("title"), _s("text"), _s("tags", T.ArrayType(T.StringType()))])
CACHE = T.StructType([_s("key"), _s("judgement"), _s("expires", T.LongType()), _s("used", T.LongType())])
GROUND_TRUTH = T.StructType([_s("seed", T.LongType()), _s("notes", T.LongType()), _s("subjects", T.LongType()), _s("corpus_hash"), _s("queries", T.ArrayType(QUERY)), _s("relevance", T.ArrayType(RELEVANCE))])
