"""Vectorisation (V1-V5): time features, text vectors, concatenation.

Text vectors come from (a) a user callable on Arrow batches, (b) a table of
precomputed vectors joined by key, (c) hashed word features in pure SQL
(no model needed), or (d) the mean of word vectors from a vectors table.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions.vectors import col_
from horosphere.session import cut_lineage, written

# Fixed values of the time encoding: day and second normalisers, origin.
D_MAX = 100000
S_MAX = 86400
ORIGIN = "1970-01-01 00:00:00"

# Words a Word2Vec task trains on in one iteration, and the most iterations (each is one job).
WORDS_PER_TASK = 1_000_000
MOST_ITERATIONS = 8

BROADCAST_WORDS = 200_000   # word vectors sent to every task at once

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _secs_of_day(t: Column) -> Column:
    return (F.hour(t) * 3600 + F.minute(t) * 60).cast("decimal(12,6)") + \
        F.date_part(F.lit("SECOND"), t).cast("decimal(12,6)")


def time_days(ts, d_max: int = D_MAX, reference: str = ORIGIN) -> Column:
    """V1 first part: floor days since ``reference`` / d_max, as FLOAT.

    Computed from calendar dates and the time of day of the wall-clock
    (TIMESTAMP_NTZ) value, so the session time zone plays no part.
    """
    t = col_(ts).cast("timestamp_ntz")
    ref = F.lit(reference).cast("timestamp_ntz")
    days = F.datediff(F.to_date(t), F.to_date(ref)) - \
        F.when(_secs_of_day(t) < _secs_of_day(ref), F.lit(1)).otherwise(F.lit(0))
    return (days.cast("double") / F.lit(float(d_max))).cast("float")


def time_seconds(ts, s_max: int = S_MAX) -> Column:
    """V1 second part: whole seconds of the day / s_max, as FLOAT."""
    t = col_(ts)
    secs = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return (secs.cast("double") / F.lit(float(s_max))).cast("float")


def time_vector(ts, d_max: int = D_MAX, s_max: int = S_MAX, reference: str = ORIGIN) -> Column:
    """V2: ``array<float>(days, seconds)``."""
    return F.array(time_days(ts, d_max, reference), time_seconds(ts, s_max))


def tokens(text) -> Column:
    """Lower-cased word tokens (letters and digits), empty tokens removed."""
    return F.filter(F.split(F.lower(col_(text)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def token_bucket(tok, dim: int) -> Column:
    """Bucket of a token: first 32 bits of its MD5, modulo ``dim``.

    When ``dim`` divides 2^8 (or 2^16) the remainder only depends on the last
    2 (or 4) of those 8 hex digits, so only they are converted.
    """
    m = F.md5(col_(tok))
    if 256 % dim == 0:
        digits = F.substring(m, 7, 2)
    elif 65536 % dim == 0:
        digits = F.substring(m, 5, 4)
    else:
        digits = F.substring(m, 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(dim))


def hashed_text_vectors(df: DataFrame, key: str, text_col: str = "text", dim: int = 64,
                        out: str = "text_vec") -> DataFrame:
    """V3 (c): L2-normalised hashed word counts, ``(key, out ARRAY<DOUBLE>)``.

    Tokens are exploded and bucketed and ``(key, bucket)`` pairs counted
    (partial aggregation map-side); a second aggregation per key gathers at
    most ``dim`` (bucket, count) entries into the vector. Keys without
    tokens get the zero vector.
    """
    toks = (df.select(key, F.explode(tokens(text_col)).alias("_tok"))
            .select(key, token_bucket("_tok", dim).alias("_b")))
    pairs = toks.groupBy(key, "_b").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    per = pairs.groupBy(key).agg(F.map_from_entries(
        F.collect_list(F.struct("_b", "_c"))).alias("_m"))
    counts = per.select(key, F.transform(F.sequence(F.lit(0).cast("bigint"),
                                                    F.lit(dim - 1).cast("bigint")),
                                         lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))
                                         ).alias("_v"))
    nrm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    # inside the lambda the norm would be worked out again for every coordinate
    counts = counts.select(key, F.zip_with("_v", F.array_repeat(nrm, dim), lambda x, n: x / n).alias(out))
    base = df.select(key).dropDuplicates([key])
    zero = F.array_repeat(F.lit(0.0), dim)
    return base.join(counts, key, "left").select(key, F.coalesce(F.col(out), zero).alias(out))


def word_vector_mean(df: DataFrame, key: str, vectors: DataFrame, dim: int,
                     text_col: str = "text", token_col: str = "token", vec_col: str = "vector",
                     out: str = "text_vec") -> DataFrame:
    """V4: mean of the vectors of a text's tokens; tokens without a vector are
    skipped, texts with none get zeros. ``vectors``: ``(token, vector)``.

    The vectors go to the texts (a broadcast), so a text's words are added up where it is read
    and only one sum per text and task is shuffled. More than BROADCAST_WORDS words
    are taken in portions of about that many, whose sums are added up.
    """
    toks = df.select(key, F.explode(tokens(text_col)).alias(token_col))
    v = vectors.select(token_col, F.col(vec_col).alias("_vec"))
    parts = max(1, -(-v.count() // BROADCAST_WORDS))
    cols = [f"_s{i}" for i in range(dim)]

    def sums(words: DataFrame) -> DataFrame:
        return toks.join(F.broadcast(words), token_col).groupBy(key).agg(
            F.count(F.lit(1)).cast("double").alias("_tot"),
            *[F.sum(F.col("_vec")[i].cast("double")).alias(c) for i, c in enumerate(cols)])

    if parts == 1:
        got = sums(v)
    else:
        v = cut_lineage(v.withColumn("_part", F.pmod(F.xxhash64(token_col), F.lit(parts))))
        got = reduce(DataFrame.unionByName, [cut_lineage(sums(v.where(F.col("_part") == p).drop("_part"))) for p in range(parts)])
        got = got.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("_tot", *cols)])
    means = got.select(key, F.array(*[F.col(c) / F.col("_tot") for c in cols]).alias(out))
    base = df.select(key).dropDuplicates([key])
    zero = F.array_repeat(F.lit(0.0), dim)
    return base.join(means, key, "left").select(key, F.coalesce(F.col(out), zero).alias(out))


def vectors_from_table(df: DataFrame, key: str, table: DataFrame, text_col: str = "text",
                       table_text: str = "text", vec_col: str = "vector", dim: int | None = None,
                       out: str = "text_vec") -> DataFrame:
    """V3 (b): precomputed vectors joined by text; texts the table lacks get zeros
    if ``dim`` is given, else NULL."""
    t = table.select(F.sha2(F.col(table_text), 256).alias("_tk"),
                     F.transform(vec_col, lambda x: x.cast("double")).alias(out)).dropDuplicates(["_tk"])
    j = df.select(key, F.sha2(F.col(text_col), 256).alias("_tk")).dropDuplicates([key]).join(t, "_tk", "left").drop("_tk")
    return j if dim is None else j.withColumn(out, F.coalesce(F.col(out), F.array_repeat(F.lit(0.0), dim)))


def train_word_vectors(texts: DataFrame, text_col: str = "text", dim: int = 64, min_count: int = 2,
                       seed: int = 42, parts: int | None = None) -> DataFrame:
    """V4: word vectors trained on the corpus (Spark ML Word2Vec) -> ``(token, vector)``.

    The corpus is dealt to ``parts`` tasks (default: one per WORDS_PER_TASK words), whose
    vectors Spark averages after every iteration; there are as many iterations as parts,
    at most MOST_ITERATIONS.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import Word2Vec
    x = texts.select(tokens(text_col).alias("_t")).where(F.size("_t") > 0)
    if parts is None:
        words = x.agg(F.sum(F.size("_t").cast("long"))).first()[0] or 0
        parts = max(1, -(-words // WORDS_PER_TASK))
    m = Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, numPartitions=parts,
                 maxIter=min(parts, MOST_ITERATIONS), inputCol="_t", outputCol="_v").fit(x)
    return m.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def embed_with(df: DataFrame, fn: Callable[[pd.Series], np.ndarray], dim: int,
               text_col: str = "text", out: str = "text_vec") -> DataFrame:
    """V3 (a): the user's sentence encoder on Arrow batches.

    ``fn(texts) -> (n, dim)`` array; every row keeps its columns.
    """
    schema = T.StructType(list(df.schema.fields)
                          + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            m = np.asarray(fn(pdf[text_col]), dtype=np.float64).reshape(len(pdf), dim)
            yield pdf.assign(**{out: list(m)})

    return df.mapInPandas(run, schema)


def concat_time(text_vec, ts=None, include_time: bool = True, **time_kw) -> Column:
    """V5: text vector ++ (days, seconds); time left out when disabled / absent."""
    tv = col_(text_vec)
    if not include_time or ts is None:
        return tv
    t = F.transform(time_vector(ts, **time_kw), lambda x: x.cast("double"))
    return F.when(col_(ts).isNull(), tv).otherwise(F.concat(tv, t))


def text_vectors(texts: DataFrame, key: str, method: str = "hashed", dim: int = 64,
                 vectors: DataFrame | None = None, fn=None, text_col: str = "text", out: str = "text_vec") -> DataFrame:
    """V3/V4 by name for one row per ``key``: hashed | word_mean (``vectors``, or
    trained on ``texts``) | table (``vectors``: text, vector) | callable (``fn``)."""
    if method == "hashed":
        return hashed_text_vectors(texts, key, text_col, dim, out)
    if method == "word_mean":
        v = vectors if vectors is not None else train_word_vectors(texts, text_col, dim)
        return word_vector_mean(texts, key, v, dim, text_col, out=out)
    if method == "table":
        return vectors_from_table(texts, key, vectors, text_col, dim=dim, out=out)
    if method == "callable":
        return embed_with(texts, fn, dim, text_col, out).select(key, out)
    raise ValueError(f"unknown method {method!r}")


def vectorize_messages(msgs: DataFrame, method: str = "hashed", dim: int = 64,
                       text_key: str | None = None, include_time: bool = True,
                       vectors: DataFrame | None = None, fn=None, out: str = "vec",
                       text_col: str = "text", rewrite=None) -> DataFrame:
    """V3-V5 for a message table: adds ``out`` = text vector ++ time vector.

    Texts are taken once per distinct ``text_key`` (default: SHA-256 of the
    original text); ``rewrite(texts)`` may replace them first (summaries). Results
    of user callables are written to the shared folder and read back, so each
    text is sent to a callable once and all its messages get the same vector.
    """
    k = text_key or "_tkey"
    x = msgs if text_key else msgs.withColumn(k, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    texts = x.select(k, text_col).dropDuplicates([k])
    if rewrite is not None:
        texts = rewrite(texts)
    tv = text_vectors(texts, k, method, dim, vectors, fn, text_col, "_tv")
    if method == "callable":
        tv = written(tv, "text-vectors")
    y = x.join(tv, k, "left")
    y = y.withColumn(out, concat_time("_tv", "created_at" if include_time else None, include_time))
    return y.drop("_tv", "_tkey")
