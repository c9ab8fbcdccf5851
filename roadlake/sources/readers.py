"""Sources. Schemas are explicit; pixels stay in files and media are referred to by path."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from roadlake import contracts


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Still images as (path, modificationTime, length, content); content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A recorded video's frame index: JSON lines of frame_id, source_id, frame_index, capture_timestamp, storage_path."""
    return spark.read.schema("frame_id string, source_id string, frame_index bigint, capture_timestamp timestamp, storage_path string").json(path)


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines ``class x_center y_center width height``; the image is the file's name. Malformed lines keep nulls and say why."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda n: F.try_element_at(parts, F.lit(n)).try_cast("double")
    out = lines.where(F.trim("value") != "").select(
        F.regexp_extract("file_path", r"([^/]+)\.txt$", 1).alias("image_id"), F.regexp_extract("file_path", r"/(train|val|test)/", 1).alias("split"),
        F.try_element_at(parts, F.lit(1)).alias("label"), number(2).alias("x_center"), number(3).alias("y_center"), number(4).alias("width"), number(5).alias("height"), F.size(parts).alias("_n"),
    )
    bad = (F.col("_n") != 5) | F.col("x_center").isNull() | F.col("y_center").isNull() | F.col("width").isNull() | F.col("height").isNull()
    return out.withColumn("reason", F.when(bad, "malformed_line")).drop("_n")


_COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotation: image, label and pixel box."""
    whole = spark.read.schema(_COCO).option("multiLine", "true").json(path).withColumn("_file", F.col("_metadata.file_path"))
    images = whole.select("_file", F.explode("images").alias("i")).select("_file", F.col("i.id").alias("image_id"), "i.file_name", F.col("i.width").alias("image_width"), F.col("i.height").alias("image_height"))
    names = whole.select("_file", F.explode("categories").alias("c")).select("_file", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    boxes = whole.select("_file", F.explode("annotations").alias("a")).select("_file", F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox")
    at = lambda n: F.try_element_at("bbox", F.lit(n))
    out = boxes.join(images, ["_file", "image_id"], "left").join(names, ["_file", "category_id"], "left")
    return out.select("annotation_id", "image_id", "file_name", "image_width", "image_height", "label", at(1).alias("x1"), at(2).alias("y1"), (at(1) + at(3)).alias("x2"), (at(2) + at(4)).alias("y2"))


def read_registry(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    reader = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in contracts.REGISTRY]))
    return reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(contracts.EVIDENCE).parquet(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment metadata files, one JSON object each; fields that a file lacks are null."""
    return spark.read.schema(", ".join(f"{f} string" for f in contracts.EXPERIMENT_FIELDS)).option("multiLine", "true").json(path)


def mock_detections(spark: SparkSession, n: int, sources: int = 10, frame_seconds: int = 1) -> DataFrame:
    """A detector's stand-in: n detections that keep the contract, the same on every run."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("d"), i.cast("string")).alias("detection_id"), F.lit("defect").alias("class"), ((i * 37) % 1001 / 1000).alias("confidence"),
        ((i * 31) % 600).cast("int").alias("x1"), ((i * 17) % 400).cast("int").alias("y1"), ((i * 31) % 600 + 20 + i % 19).cast("int").alias("x2"), ((i * 17) % 400 + 20 + i % 23).cast("int").alias("y2"),
        F.concat(F.lit("f"), i.cast("string")).alias("frame_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.expr(f"id div {sources}") * frame_seconds).alias("capture_timestamp"), (i % sources).cast("string").alias("source_id"),
    )


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _CameraReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.rate, self.limit = int(options.get("frames_per_batch", 100)), int(options.get("frames", 1000))
        self.sources, self.at = int(options.get("sources", 4)), 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.limit, self.at + self.rate)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["frame"])
        step = max(1, -(-(end["frame"] - start["frame"]) // 4))
        return [_Range(a, min(a + step, end["frame"])) for a in range(start["frame"], end["frame"], step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import datetime

        for n in range(partition.start, partition.end):
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=40 * n)
            yield (f"f{n}", str(n % self.sources), n // self.sources, at)


class CameraSource(DataSource):
    """A live camera's stand-in with bounded intake: format ``camera``, options frames, frames_per_batch, sources."""

    @classmethod
    def name(cls) -> str:
        return "camera"

    def schema(self) -> str:
        return "frame_id string, source_id string, frame_index bigint, capture_timestamp timestamp"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _CameraReader(self.options)


def read_stream(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(CameraSource)
    return spark.readStream.format("camera").options(**{k: str(v) for k, v in options.items()}).load()
