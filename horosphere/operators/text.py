"""Text operators (T1-T8): prompts, mock summary, model calls with a cache.

The model itself is the user's: any callable ``pd.Series[str] -> pd.Series[str]``
(prompts in, summaries out). It runs inside ``mapInPandas`` on Arrow batches,
so partitions are the parallelism; a call that fails is repeated row by row,
and a failing row keeps its original text with ``success = false``.
"""

from __future__ import annotations

import time
from typing import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions.vectors import col_

# The four prompt templates, verbatim.
PROMPTS = {
    "summarize": ("Summarize the following sentences: {text}. "
                  "If you come across some abbreviations, expand them. "
                  "Please respond in English."),
    "paraphrase": ("Paraphrase the following sentences: {text}. "
                   "If you come across some abbreviations, expand them. "
                   "Please respond in English."),
    "summarize_simple": "Summarize the following sentences: {text}.",
    "summarize_no_lang": ("Summarize the following sentences: {text}. "
                          "If you come across some abbreviations, expand them."),
}

# Model short name -> served model name, and the fallback.
MODEL_NAMES = {"llama3.1": "llama3.1:8b", "qwen2.5": "qwen2.5:7b", "gemma2": "gemma2:9b"}
DEFAULT_MODEL = "llama3.1:8b"

# The mock model's marker, its output prefix.
MOCK_MARKER = "sentences:"
MOCK_PREFIX = "[Summarized] "

# Characters Python's str.strip() removes (Unicode white space + \x1c-\x1f).
_WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = f"^{_WS}+|{_WS}+$"


def prompt_template(prompt_type: str = "summarize", overrides: dict | None = None) -> str:
    """Template by (case-insensitive) name; unknown names give 'summarize'.

    ``overrides`` (name -> template) wins over the built-in text.
    """
    if overrides and prompt_type in overrides:
        return overrides[prompt_type]
    return PROMPTS.get(prompt_type.lower(), PROMPTS["summarize"])


def build_prompt(text, template: str) -> Column:
    """The template with every ``{text}`` filled in."""
    parts = template.split("{text}")
    filled = [F.lit(parts[0])]
    for p in parts[1:]:
        filled += [col_(text), F.lit(p)]
    return F.concat(*filled)


def py_strip(s: Column) -> Column:
    return F.regexp_replace(s, STRIP_PATTERN, "")


def mock_summary(prompt) -> Column:
    """Text after the last ``sentences:`` up to the first ``.``, stripped.

    The marker test ignores case, the split does not (as in the original
    mock); prompts without the marker come back unchanged.
    """
    p = col_(prompt)
    after = F.split_part(p, F.lit(MOCK_MARKER), F.lit(-1))
    body = py_strip(F.split_part(after, F.lit("."), F.lit(1)))
    return F.when(F.lower(p).contains(MOCK_MARKER), F.concat(F.lit(MOCK_PREFIX), body)) \
            .otherwise(p)


def resolve_model(key: str = "llama3.1", names: dict | None = None) -> str:
    """Served name for a short name; config table first, then built-in."""
    table = names if names is not None else MODEL_NAMES
    return table.get(key, MODEL_NAMES.get(key, DEFAULT_MODEL))


def resolve_model_col(key, names: dict | None = None) -> Column:
    """T7 as a column: ``coalesce(config[key], builtin[key], default)``."""
    k = col_(key)
    builtin = F.create_map(*[x for kv in MODEL_NAMES.items() for x in map(F.lit, kv)])
    parts = []
    if names:
        parts.append(F.create_map(*[x for kv in names.items() for x in map(F.lit, kv)])[k])
    parts += [builtin[k], F.lit(DEFAULT_MODEL)]
    return F.coalesce(*parts)


SUMMARY_FIELDS = [
    T.StructField("summary", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
]


def summarize(df: DataFrame, fn: Callable[..., pd.Series], text_col: str = "text",
              prompt_type: str = "summarize", model: str = DEFAULT_MODEL,
              overrides: dict | None = None, options: dict | None = None,
              call_rows: int = 64) -> DataFrame:
    """T4/T5: every row through the user's model, with failure capture.

    Adds ``summary, model, success, error, seconds``. ``fn`` is built once per
    task (it is pickled with the closure) and called with at most ``call_rows`` prompts
    at a time. With ``options`` (e.g. temperature, max_tokens) it is
    called as ``fn(prompts, model=model, **options)``. A call that fails is
    repeated row by row for its own rows only; rows that fail again keep their text.
    """
    template = prompt_template(prompt_type, overrides)
    out_schema = T.StructType(df.schema.fields + SUMMARY_FIELDS)
    names = out_schema.names
    given = {} if options is None else {"model": model, **options}

    def call(prompts: pd.Series) -> list:
        got = list(fn(prompts, **given))
        if len(got) != len(prompts):
            raise ValueError("model returned a different number of rows")
        return got

    def timed(prompts: pd.Series, texts: pd.Series):
        """(summary, success, error, seconds) for each row of one call."""
        t0 = time.perf_counter()
        try:
            got = call(prompts)
            secs = (time.perf_counter() - t0) / len(got)
            return [(g, True, None, secs) for g in got]
        except Exception as e:  # noqa: BLE001 - the row records the error
            if len(prompts) == 1:
                return [(texts.iloc[0], False, str(e), time.perf_counter() - t0)]
        return [r for i in range(len(prompts)) for r in timed(prompts.iloc[i:i + 1], texts.iloc[i:i + 1])]

    def run(batches):
        import pyarrow as pa
        string = lambda x: pa.Array.from_pandas(pd.Series(x, dtype=object), type=pa.string())
        for b in batches:
            for lo in range(0, b.num_rows, call_rows):          # prompts and answers exist for one call at a time
                part = b.slice(lo, call_rows)
                texts = pd.Series(part.column(text_col).to_pylist(), dtype=object)
                prompts = pd.Series([None if t is None else template.replace("{text}", t) for t in texts], dtype=object)
                summary, ok, err, secs = zip(*timed(prompts, texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, string(summary), string([model] * len(ok)), pa.array(ok, pa.bool_()), string(err),
                     pa.array(secs, pa.float64())], names)

    return df.mapInArrow(run, out_schema)


def summary_stats(summarized: DataFrame) -> DataFrame:
    """T5 statistics: rows, successes, total seconds."""
    return summarized.agg(F.count(F.lit(1)).alias("rows"),
                          F.count_if(F.col("success")).alias("succeeded"),
                          F.sum("seconds").alias("seconds"))


def text_key(text) -> Column:
    """Cache key of a text (SHA-256 hex)."""
    return F.sha2(col_(text), 256)


def cache_misses(df: DataFrame, cache: DataFrame, text_col: str = "text",
                 model: str | None = None, prompt_type: str | None = None) -> DataFrame:
    """T8 step 1: distinct texts not yet in the cache (left anti join)."""
    c = cache
    if model is not None:
        c = c.where(F.col("model") == model)
    if prompt_type is not None:
        c = c.where(F.col("prompt_type") == prompt_type)
    texts = df.select(text_key(text_col).alias("key"), F.col(text_col).alias("text")) \
              .dropDuplicates(["key"])
    return texts.join(c.select("key").distinct(), "key", "left_anti")


def apply_cache(df: DataFrame, cache: DataFrame, text_col: str = "text",
                model: str | None = None, prompt_type: str | None = None) -> DataFrame:
    """T8 step 3: summaries joined back by key; ``from_cache`` marks hits."""
    c = cache
    if model is not None:
        c = c.where(F.col("model") == model)
    if prompt_type is not None:
        c = c.where(F.col("prompt_type") == prompt_type)
    c = c.select("key", F.col("summary").alias("_cached")).dropDuplicates(["key"])
    x = df.withColumn("_key", text_key(text_col)).join(
        c.withColumnRenamed("key", "_key"), "_key", "left")
    return (x.withColumn("from_cache", F.col("_cached").isNotNull())
            .withColumn("summary", F.coalesce(F.col("_cached"), F.col(text_col)))
            .drop("_key", "_cached"))


def read_cache(spark, cache_path: str) -> DataFrame:
    """The cache table; empty where none was written yet. Any other read error is raised."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def summarize_cached(df: DataFrame, fn, cache_path: str, text_col: str = "text",
                     prompt_type: str = "summarize", model: str = DEFAULT_MODEL,
                     options: dict | None = None) -> DataFrame:
    """Summaries through a persistent Parquet cache.

    Only distinct texts that the cache lacks reach ``fn``, once; new entries
    are appended to the cache table (shared storage), which is read back, then every
    row is joined to its summary. A model that answers differently each time
    therefore still gives one summary per text.
    """
    spark = df.sparkSession
    misses = cache_misses(df, read_cache(spark, cache_path), text_col, model, prompt_type)
    new = summarize(misses, fn, "text", prompt_type, model, options=options).where(F.col("success"))
    (new.select("key", "model", F.lit(prompt_type).alias("prompt_type"), "summary")
     .write.mode("append").parquet(cache_path))
    return apply_cache(df, read_cache(spark, cache_path), text_col, model, prompt_type)


CACHE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("prompt_type", T.StringType()), T.StructField("summary", T.StringType())])


def summarize_mock_sql(df: DataFrame, text_col: str = "text",
                       prompt_type: str = "summarize", out: str = "summary") -> DataFrame:
    """T2+T3+T6 with the mock model entirely as built-in expressions."""
    p = build_prompt(text_col, prompt_template(prompt_type))
    return df.withColumn(out, mock_summary(p))
