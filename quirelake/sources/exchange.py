"""Formats that other tools write or read: vector archives, annotation lists, line-wise batches, page files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise

_FALLBACK: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, which all executors share; unset, a temporary one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _FALLBACK.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quirelake-"))
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(top)
    store.deleteOnExit(top)
    return top.toString()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io

    import numpy as np

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as archive:
                names = archive.files
                rows = archive[next((n for n in ("embeddings", "img_emb") if n in names), names[0])]
            rows = rows.reshape(len(rows), -1).astype(np.float64)
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), flat], ["path", "row", "embedding"])


def read_vector_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, embedding) of ``.npz`` files: the array ``embeddings``, else ``img_emb``, else the first; of unit length.

    An archive is read whole by one task; arrays of more than two dimensions are flattened to vectors.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(_vectors, "path string, row long, embedding array<double>").withColumn("embedding", l2_normalise(F.col("embedding")))


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(training examples, skipped entries) of files that hold a list of ``{image, ground_truth}``.

    An entry without a picture or with a blank text is skipped, like one that is no object; both are counted by entry.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.from_json("value", "array<string>")).alias("entry", "value"))
    field = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    rows = raw.select("file_path", "entry", "value", field("image", "image_path", "file_name").alias("image"), field("ground_truth", "text", "transcription").alias("text"))
    good = F.coalesce((F.trim("image") != "") & (F.trim("text") != ""), F.lit(False))
    return rows.where(good).drop("value"), rows.where(~good).select("file_path", "entry", "value")


def read_batches(spark: SparkSession, prefix: str, schema: str) -> DataFrame:
    """Line-wise batch files of a folder with their file name; lines that are no records are NULL throughout."""
    return spark.read.schema(schema).json(f"{prefix}").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1))


def write_batches(df: DataFrame, folder: str, order: str, size: int, stamp: str) -> None:
    """``batch=n`` folders of ``size`` rows in order, named by run; UTF-8, absent fields left out.

    Places come from counts per partition of a range partitioning, so no task sees all rows.
    """
    placed = ordinals(df, order)
    named = placed.withColumn("batch", F.concat(F.lit("batch_"), F.floor(F.col("ordinal") / size).cast("string"), F.lit(f"_{stamp}"))).drop("ordinal")
    named.write.mode("errorifexists").partitionBy("batch").json(folder)


def ordinals(df: DataFrame, order: str) -> DataFrame:
    """``df`` with its 0-based place in the order of a column without repeats."""
    spark = df.sparkSession
    sorted_path = scratch_folder(spark, "sorted")
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    ranged.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * F.lit(1 << 33)).write.mode("overwrite").parquet(sorted_path)
    kept = spark.read.parquet(sorted_path)
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one number a partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return kept.withColumn("ordinal", F.lit(0).cast("long")).drop("__part", "__in")
    starts = spark.createDataFrame(list(before.items()), "__part int, __start long")
    return kept.join(F.broadcast(starts), "__part").withColumn("ordinal", F.col("__in") + F.col("__start")).drop("__part", "__in", "__start")


def first_rows(df: DataFrame, order: list[str], most: int = 100_000) -> DataFrame:
    """The first rows by a total order: what a capped read of a stream takes."""
    return df.orderBy(*order).limit(most)


def page_file(number: Column, kind: str = "structured") -> Column:
    return F.format_string(f"page_%03d_{kind}.json", number)


def page_summary(pages: DataFrame, by: str, text: str) -> DataFrame:
    """One summary row per document: pages, pages with text, characters."""
    there = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    return pages.groupBy(by).agg(F.count("*").alias("total_pages"), F.count_if(there).alias("pages_with_text"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))


def text_target(path: Column) -> Column:
    """Where extracted text goes: beside a ``.json`` file under its stem, else into the folder."""
    return F.when(path.endswith(".json"), F.concat(F.regexp_replace(path, r"\.json$", ""), F.lit("_text.txt"))).otherwise(F.concat(F.rtrim(path, F.lit("/")), F.lit("/extracted_text.txt")))


def export_row(df: DataFrame, columns: list[str]) -> Column:
    """The chosen columns as one JSON text, absent ones left out."""
    return F.to_json(F.struct(*[F.col(c) for c in columns if c in df.columns]))


def ocr_page_texts(results: DataFrame) -> DataFrame:
    """(page_number, full_text): one row per page of OCR results that holds text."""
    page = results.select(F.explode("pages").alias("p"))
    return page.select("p.page_number", F.col("p.ocr_result.full_text").alias("full_text")).where("full_text is not null")
