"""Readers of the engine's sources: image folders, posted images, dictionaries, galleries, look-up tables, live streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader

from strandline.operators.sampling import magic_kind
from strandline.sources.tables import materialise

#: Suffixes of image files, as they are written.
SUFFIXES = ("jpg", "JPEG", "png", "bmp")
#: Rows that a dictionary or table file read on the driver may have; larger ones must come as tables.
DICTIONARY_ROWS = 1_000_000
VIDEO_PREFIX = {"RTSP": "rtsp://", "RTMP": "rtmp://", "GB28181": "gb28181://"}


def read_image_dir(spark: SparkSession, path: str, loops: int = 1, with_content: bool = True) -> DataFrame:
    """frame_id, path, kind, content of the images below a folder in order of path; ids go on growing over the loops."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.substring_index("path", ".", -1).isin(*SUFFIXES))
    # names are sorted by ranges; what the driver sees is the number of names in each range
    ranged = materialise(files.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("m", F.monotonically_increasing_id()), "image-names")
    sizes = dict(ranged.groupBy(F.shiftright("m", 33).cast("int")).count().collect())
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    first = F.try_element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.shiftright("m", 33).cast("int")) if before else F.lit(0)
    numbered = ranged.select("path", (first + F.col("m").bitwiseAND((1 << 33) - 1)).alias("n")).withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    out = numbered.join(files.select("path", "content"), "path")
    out = out.select((F.col("n") + F.col("loop") * total).cast("long").alias("frame_id"), "path", magic_kind(F.col("content")).alias("kind"), "content")
    return out if with_content else out.drop("content")


def read_posted_images(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Images posted as JSON {"data": base64}, from a landing folder; bodies that hold no JPEG, PNG or BMP are skipped."""
    reader = (spark.readStream if stream else spark.read).schema("channel_id int, data string, posted_at timestamp")
    rows = reader.json(path).withColumn("content", F.try_to_binary("data", F.lit("base64")))
    return rows.withColumn("kind", magic_kind(F.col("content"))).where("kind is not null").drop("data")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file; refuses files that aren't small."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"{path} holds more than one file")
    lines = rows[0][0].splitlines() if rows else []
    if len(lines) > DICTIONARY_ROWS:
        raise ValueError(f"{path} has {len(lines)} lines; keep it as a table")
    return lines


def read_dictionary(spark: SparkSession, path: str, id_name: str = "class_id", name: str = "class_name") -> DataFrame:
    """Names one a line; the line number, from 0, is the id."""
    return spark.createDataFrame(list(enumerate(read_lines(spark, path))), f"{id_name} int, {name} string")


def read_gallery(spark: SparkSession, vectors: str, labels: str) -> DataFrame:
    """vec_id, embedding, label of a file of blank-separated numbers and its parallel label file."""
    v, names = read_lines(spark, vectors), read_lines(spark, labels)
    rows = [(i, [float(x) for x in line.split()], names[i] if i < len(names) else None) for i, line in enumerate(v) if line.strip()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")


def read_lut(spark: SparkSession, path: str) -> list[int]:
    """A table of 256 entries, one number a line or blank-separated."""
    values = [int(x) for line in read_lines(spark, path) for x in line.replace(",", " ").split()]
    if len(values) != 256:
        raise ValueError(f"{path} holds {len(values)} entries, not 256")
    return values


def valid_live_url(url: str, source_type: str) -> bool:
    return url.startswith(VIDEO_PREFIX.get(source_type, ""))


def live_frames(spark: SparkSession, channels: list[int], fps: float = 25.0) -> DataFrame:
    """A synthetic live source: frames of every channel at `fps`, in lock step, from Spark's rate source."""
    rows = max(1, int(fps * len(channels)))
    beat = spark.readStream.format("rate").option("rowsPerSecond", rows).load()
    n = len(channels)
    return beat.select(F.element_at(F.array(*map(F.lit, channels)), (F.col("value") % n + 1).cast("int")).alias("channel_id"), F.floor(F.col("value") / n).alias("frame_id"), F.col("timestamp").alias("ts"))


class FrameStreamReader(SimpleDataSourceStreamReader):
    """Numbers frames of `channels` channels by the clock; an offset is the next frame id, so a restart repeats nothing."""

    def __init__(self, options: dict):
        self.channels, self.fps, self.limit = int(options.get("channels", 1)), float(options.get("fps", 25)), int(options.get("frames", 1 << 40))
        self.began = time.time()

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def _rows(self, a: int, b: int):
        return iter([(c, f, f == self.limit - 1) for f in range(a, b) for c in range(self.channels)])

    def read(self, start: dict):
        until = min(self.limit, max(start["frame"], int((time.time() - self.began) * self.fps)))
        return self._rows(start["frame"], until), {"frame": until}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start["frame"], end["frame"])

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """spark.readStream.format("frames").option("channels", 4).option("fps", 25): a source plug-in for live channels.

    As a batch source it gives `frames` frames of each channel, one partition a channel. The last frame bears the end mark.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "channel_id int, frame_id long, eos boolean"

    def simpleStreamReader(self, schema: T.StructType) -> FrameStreamReader:
        return FrameStreamReader(self.options)

    def reader(self, schema: T.StructType):
        from pyspark.sql.datasource import DataSourceReader

        options = self.options

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(c) for c in range(int(options.get("channels", 1)))]

            def read(self, partition):
                n = int(options.get("frames", 100))
                for f in range(n):
                    yield partition.value, f, f == n - 1

        return Reader()
