"""Reading documents: which files, which columns, how many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCE_COLUMNS = ("title", "text", "namespace", "contributors")
BUCKETS_PER_PASS = 1024
SPREAD_BELOW = 64 * 1024 * 1024


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def spread_small_file(df: DataFrame, path: str, key: str = "id", below: int = SPREAD_BELOW) -> DataFrame:
    """Deal a small file's rows out over all cores.

    A file is read by as many tasks as it has row groups, and a small one has a single row
    group. Large inputs are left as they are: their own splits keep every core busy.
    """
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getContentSummary(target).getLength() >= below:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def select_shards(manifest: DataFrame, split: str = "train", first_only: bool = False) -> list[str]:
    """Paths of the wanted split's files from ``manifest(ordinal, url, split)``; an error if it has none.

    All of them, or with ``first_only`` the one that comes first.
    """
    shards = manifest.filter(F.col("split") == split).orderBy("ordinal").select("url")
    urls = [row["url"] for row in (shards.limit(1) if first_only else shards).collect()]
    if not urls:
        raise ValueError(f"the manifest lists no file for split {split}")
    return urls


def resolve_paths(
    spark: SparkSession,
    local_path: str | None = None,
    working_dir: str | None = None,
    repository: str | None = None,
    commit: str | None = None,
    file_name: str | None = None,
    manifest: DataFrame | None = None,
    split: str = "train",
    first_only: bool = False,
) -> list[str]:
    """A given path wins, as it stands or below ``working_dir``; then a pinned file; then the manifest."""

    def given(value: str | None) -> str:
        return (value or "").strip()

    if given(local_path):
        candidates = [given(local_path)]
        if working_dir:
            candidates.append(f"{working_dir.rstrip('/')}/{given(local_path)}")
        for candidate in candidates:
            if path_exists(spark, candidate):
                return [candidate]
        raise FileNotFoundError(f"no document file at {' or '.join(candidates)}")
    if given(commit) and given(file_name):
        return [f"{(repository or '').rstrip('/')}/{given(commit)}/{given(file_name)}"]
    if manifest is None:
        raise ValueError("no path, no pinned file and no manifest")
    return select_shards(manifest, split, first_only)


def normalise(raw: DataFrame) -> DataFrame:
    """The four document columns by name, as strings; missing ones are null, extras are dropped.

    Null title and text become ``''``; null namespace and contributors stay null. Any other
    key column of the source can be kept by selecting it beside these expressions.
    """
    return raw.select(*source_expressions(raw))


def source_expressions(raw: DataFrame) -> list:
    def text(name: str):
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    required = {"title", "text"}
    return [
        (F.coalesce(text(name), F.lit("")) if name in required else text(name)).alias(name)
        for name in SOURCE_COLUMNS
    ]


def read_documents(spark: SparkSession, paths: list[str], limit: int = 0) -> DataFrame:
    """The documents in the files of ``paths``, or the first ``limit`` of them in the order of file names and rows.

    Rows are counted per file, from footers alone, up to the file the limit falls in. The rows kept are then a filter on
    file names and places in a file: no task gathers them, and every run gives the same ones.
    """
    raw = spark.read.parquet(*paths)
    if limit <= 0:
        return normalise(raw)
    counts = raw.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.select("path", (F.lit(limit) - F.coalesce(before, F.lit(0))).alias("left"), "n").filter("left > 0")
    files = needed.orderBy("path").collect()  # the files that hold the first rows
    whole = [row["path"] for row in files if row["n"] <= row["left"]]
    part = [row for row in files if row["n"] > row["left"]]
    kept = F.col("_metadata.file_path").isin(whole)
    for row in part:
        kept = kept | ((F.col("_metadata.file_path") == row["path"]) & (F.col("_metadata.row_index") < row["left"]))
    return normalise(raw.filter(kept))


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The rows with the ``n`` lowest values of the long ``key``; all rows if ``n`` is 0 or less.

    Null keys come last. Rows that tie with the n-th one stay too, so a unique key gives
    exactly ``n`` rows and every run gives the same ones. The n-th key is located by counting
    keys in ever narrower ranges, so the result is a plain range filter the scan can prune by,
    and no task has to hold the n rows.
    """
    if n <= 0:
        return df
    threshold = _nth_key(df, n, key)
    return df if threshold is None else df.filter(F.col(key) <= threshold)


def _nth_key(df: DataFrame, n: int, key: str) -> int | None:
    """The n-th lowest key, or None if fewer than ``n`` rows have one."""
    low, high, total = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if total < n:
        return None
    while low < high:
        width = (high - low) // BUCKETS_PER_PASS + 1
        bucket = F.expr(f"cast((`{key}` - {low}L) div {width}L AS int)")
        counts = (
            df.filter(F.col(key).between(low, high))
            .groupBy(bucket.alias("bucket"))
            .count()
            .orderBy("bucket")
            .collect()  # at most BUCKETS_PER_PASS rows
        )
        for row in counts:
            if n <= row["count"]:
                low, high = low + row["bucket"] * width, min(high, low + (row["bucket"] + 1) * width - 1)
                break
            n -= row["count"]
    return low


def corpus_view(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Tables ``documents(doc_id, text, lang, source)`` and ``embeddings(vec_id, embedding)`` as a corpus.

    The title is the text's first line; a document without a vector keeps null.
    """
    vectors = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return corpus_texts(documents).join(vectors, "id", "left")


def corpus_texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.col("lang").alias("namespace"),
        F.col("source").alias("contributors"),
    )
