"""Text embedding with an incremental cache, and vector reduction.

The cache is a Parquet table (model, text_key, vector) keyed by the model name and the
md5 of the *text* (not the person id, so a changed text is re-embedded). Only distinct
texts that are not cached yet are encoded; new rows are appended as new part files,
never by rewriting the path being read.

Encoders are pluggable:

* ``HashingEncoder`` (default) -- word tokens hashed into ``dim`` buckets and mean
  pooled over the real tokens; runs entirely in the JVM (``RegexTokenizer`` +
  ``HashingTF``), so it is safe to use on any cluster without Python model files.
* ``BatchEncoder`` -- any Python model: ``make_predict_fn`` is called once per Python
  worker and then fed Arrow batches of ``batch_size`` texts (``predict_batch_udf``).
* ``TokenEncoder`` -- a Python model of token vectors; first-token or masked mean pooling
  is a column expression over them.

I5: ``max_tokens`` keeps the first tokens of a text (word tokens; for a ``BatchEncoder``
what white space parts). It is off by default and part of the model name, so the cache
never mixes truncated and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, HashingTF, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _ship_by_value() -> None:
    # encoder helpers travel in the task closure (no install needed on executors)
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def text_stats_model():
    """A tiny deterministic text model for batch inference (I4): per text, the number of
    characters, of letters 'e' and of ASCII digits, as float32. ``predict_batch_udf``
    calls this once per Python worker and then feeds it Arrow batches."""
    import re

    import numpy as np
    digits = re.compile(r"[0-9]")

    def predict(texts):
        return np.array([[len(t), t.count("e"), len(digits.findall(t))] for t in texts], dtype=np.float32)
    return predict


CACHE_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("text_key", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType()), True),
])


def check_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """Fail fast on the driver when an input column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing columns {missing}")


def text_key(col: str) -> F.Column:
    return F.md5(F.col(col).cast("string"))


def model_name(name: str, max_tokens: int | None) -> str:
    if max_tokens is not None and max_tokens < 1:
        raise ValueError("max_tokens must be 1 or more")
    return name if max_tokens is None else f"{name}-max{max_tokens}"


class HashingEncoder:
    """JVM-side bag-of-words encoder with masked mean pooling."""

    def __init__(self, dim: int = 64, name: str | None = None, max_tokens: int | None = None):
        self.dim, self.max_tokens = dim, max_tokens
        self.name = model_name(name or f"hashing-{dim}", max_tokens)

    def encode(self, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
        tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="\\W+", toLowercase=True)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=self.dim)
        words = tok.transform(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))))
        if self.max_tokens is not None:
            words = words.withColumn("_tok", F.slice("_tok", 1, self.max_tokens))
        x = tf.transform(words)
        n = F.size("_tok").cast("float")
        arr = vector_to_array("_tf", "float32")
        pooled = F.when(n > 0, F.transform(arr, lambda v: (v / n).cast("float"))).otherwise(arr)
        return x.withColumn(out, pooled).drop("_tok", "_tf")


class BatchEncoder:
    """Python model behind ``predict_batch_udf``: loaded once per worker, batched input."""

    def __init__(self, make_predict_fn: Callable, dim: int, name: str, batch_size: int = 32,
                 max_tokens: int | None = None):
        self.dim, self.name, self.batch_size = dim, model_name(name, max_tokens), batch_size
        self.max_tokens = max_tokens
        self._udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                                      batch_size=batch_size)

    def encode(self, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        if self.max_tokens is not None:
            words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
            text = F.when(F.size(words) > self.max_tokens,
                          F.array_join(F.slice(words, 1, self.max_tokens), " ")).otherwise(text)
        return df.withColumn(out, self._udf(text))


POOLINGS = ("first", "mean")


def pool(tokens: F.Column, pooling: str, dim: int) -> F.Column:
    """One vector of a text's token vectors, as a column expression: the first token's,
    or the mean over the tokens that the text has (padding never enters). Without tokens a
    zero vector."""
    if pooling not in POOLINGS:
        raise ValueError(f"pooling must be one of {POOLINGS}")
    zero = F.array_repeat(F.lit(0.0), dim)
    if pooling == "first":
        vector = F.coalesce(F.get(tokens, 0).cast("array<double>"), zero)
    else:
        total = F.aggregate(tokens, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
        vector = F.transform(total, lambda v: v / F.greatest(F.size(tokens), F.lit(1)))
    return vector.cast("array<float>")


class TokenEncoder:
    """A Python model that gives a vector for every token of a text, pooled by ``pool``.

    ``make_token_fn`` is called once per task and returns a function from a list of texts to
    a list of (tokens x ``dim``) arrays; ``batch_size`` texts are given to it at a time, and
    each text keeps its first ``max_tokens`` tokens. Token vectors leave the worker as flat
    numbers after every such batch, so that it never holds more of them than one."""

    def __init__(self, make_token_fn: Callable, dim: int, name: str, pooling: str = "mean",
                 batch_size: int = 32, max_tokens: int | None = None):
        if pooling not in POOLINGS:
            raise ValueError(f"pooling must be one of {POOLINGS}")
        self.dim, self.pooling, self.max_tokens = dim, pooling, max_tokens
        self.name = model_name(f"{name}-{pooling}", max_tokens)
        self.make, self.batch_size = make_token_fn, batch_size

    def token_vectors(self, text: F.Column) -> F.Column:
        make, size, most = self.make, self.batch_size, self.max_tokens

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = make()
            for texts in batches:
                for at in range(0, len(texts), size):
                    yield _nested([np.asarray(v, dtype=np.float32)[:most] for v in model(texts.slice(at, size).to_pylist())])

        return F.arrow_udf(run, "array<array<float>>")(F.coalesce(text, F.lit("")))

    def encode(self, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
        made = df.withColumn("_tokens", self.token_vectors(F.col(text_col)))
        return made.withColumn(out, pool(F.col("_tokens"), self.pooling, self.dim)).drop("_tokens")


def _nested(vectors: list[np.ndarray]) -> pa.Array:
    """One list of token vectors for every text, over one flat array of numbers."""
    flat = [v.ravel() for v in vectors]
    widths = [v.shape[1] if v.size else 0 for v in vectors for _ in range(len(v))]
    inner = pa.ListArray.from_arrays(np.cumsum([0, *widths], dtype=np.int32), pa.array(np.concatenate(flat), pa.float32()))
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, vectors)], dtype=np.int32), inner)


def token_stats_model():
    """A tiny deterministic token model: per token (what spaces, tabs and line ends part) its
    length, its letters 'e' and its ASCII digits."""
    import re

    import numpy as np
    token, digit = re.compile("[^ \t\n\x0b\x0c\r]+"), re.compile("[0-9]")

    def model(texts):
        return [np.array([[len(t), t.count("e"), len(digit.findall(t))] for t in token.findall(x)],
                         dtype=np.float32).reshape(-1, 3) for x in texts]
    return model


def read_cache(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The cache table, or an empty frame when it does not exist yet."""
    if _exists(spark, path):
        df = spark.read.schema(CACHE_SCHEMA).parquet(path)
    else:
        df = spark.createDataFrame([], CACHE_SCHEMA)
    return df.where(F.col("model") == model) if model else df


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing_texts(df: DataFrame, text_col: str, cache: DataFrame) -> DataFrame:
    """J5 + D2: distinct (text_key, text) whose key is not in the cache (left-anti)."""
    keys = (df.select(F.col(text_col).alias("text"))
              .where(F.col("text").isNotNull())
              .select(text_key("text").alias("text_key"), "text")
              .dropDuplicates(["text_key"]))
    return keys.join(cache.select("text_key").distinct(), "text_key", "left_anti")


def embed_new(df: DataFrame, text_col: str, cache: DataFrame, encoder) -> DataFrame:
    """I1 + I3: cache rows for the texts that still need a vector."""
    todo = missing_texts(df, text_col, cache)
    enc = encoder.encode(todo, "text", "vector")
    return enc.select(F.lit(encoder.name).alias("model"), "text_key", "vector")


def append_cache(new_rows: DataFrame, path: str) -> None:
    """Append new part files; existing files are never rewritten."""
    new_rows.write.mode("append").partitionBy("model").parquet(path)


def embed_with_cache(spark: SparkSession, df: DataFrame, text_col: str, key: str, cache_path: str,
                     encoder, max_broadcast_rows: int = 1_000_000) -> tuple[DataFrame, int]:
    """I3 end to end: encode the missing texts, append them, then attach every row's
    vector by text key (J6/J7). Returns (df + vector, number of texts encoded now)."""
    check_columns(df, [text_col, key])
    cache = read_cache(spark, cache_path, encoder.name)
    from cohortkit.session import materialise
    new = materialise(embed_new(df, text_col, cache, encoder))
    n_new = new.count()
    if n_new:
        append_cache(new, cache_path)
    cache = read_cache(spark, cache_path, encoder.name).select("text_key", "vector").dropDuplicates(["text_key"])
    keyed = df.withColumn("text_key", text_key(text_col))
    from cohortkit.operators.cohort import lookup
    return lookup(keyed, cache, "text_key", max_broadcast_rows=max_broadcast_rows), n_new


# ---------------------------------------------------------------- reduction
def pca(df: DataFrame, vec_col: str, k: int, out: str = "reduced") -> DataFrame:
    """V1: centred PCA to ``k`` dimensions (scikit-learn's default: centre, no scaling).

    Spark's PCA does not centre, so a mean-only ``StandardScaler`` runs first; each
    component's sign is fixed so its largest-magnitude loading is positive (SVD signs
    are arbitrary). The fit is a distributed covariance (a d x d aggregate)."""
    x = df.withColumn("_v", array_to_vector(F.col(vec_col)))
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(x)
    xc = sc.transform(x)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(xc)
    comps = model.pc.toArray()  # d x k, the model itself (small)
    signs = [1.0 if comps[abs(comps[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    arr = vector_to_array(F.col("_p"))
    flipped = F.array(*[arr[j] * F.lit(signs[j]) for j in range(k)])
    return model.transform(xc).withColumn(out, flipped).drop("_v", "_c", "_p")


def to_columns(df: DataFrame, arr_col: str, k: int, prefix: str = "embed_", keep: Sequence[str] = ()) -> DataFrame:
    """V3: array -> ``embed_0 .. embed_{k-1}`` columns, keyed."""
    return df.select(*keep, *[F.col(arr_col)[i].alias(f"{prefix}{i}") for i in range(k)])
