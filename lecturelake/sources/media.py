"""Sources: images, manifests of uploads, packet dumps and PCM audio as DataFrames."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.sources.pcm import PcmWindows, file_system

# File types that an upload may have.
VIDEO_TYPES = ("mp4", "mov", "avi", "mkv")
AUDIO_TYPES = ("mp3",)
LEAST_BYTES = 32
#: A decimal number with or without fraction and exponent; Spark's own cast would also take endings such as 1d.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Image rows as the built-in source gives them (BGR); unreadable files stay as rows with an empty image."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def write_gray_images(rows: DataFrame, path: str, width: int) -> DataFrame:
    """Writes a PNG file <name>.png for each name of rows (name, place, levels), whose levels (0 to 255) follow each other by place; gives name, height.

    A picture without levels is a file that breaks off after its signature. A file gets its name once it is whole. ``path`` is a folder that all executors share.
    """
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        system.create_dir(folder)
        for b in batches:
            names, heights = b.column(0).to_pylist(), []
            for name, levels in zip(names, b.column(1), strict=True):
                v = levels.values.to_numpy().astype(np.uint8).reshape(-1, width)
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(b"\x89PNG\r\n\x1a\n")
                    if len(v):
                        lines = np.concatenate((np.zeros((len(v), 1), np.uint8), v), axis=1).tobytes()
                        out.write(chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(v), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
                system.move(part, f"{folder}/{name}.png")
                heights.append(len(v))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(heights, pa.int64())], names=["name", "height"])

    pictures = rows.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "levels"))), lambda r: r["levels"])).alias("levels"))
    return pictures.mapInArrow(write, "name string, height long")


def manifest_rows(files: DataFrame) -> DataFrame:
    """lesson_id, accepted, reason for uploads (lesson_id, path, kind, length): a video alone, or an image with audio."""
    kind = F.lower("kind")
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    n = lambda k: F.count_if(kind == k)
    sums = files.groupBy("lesson_id").agg(
        n("video").alias("videos"),
        n("image").alias("images"),
        n("audio").alias("audios"),
        F.count_if(F.col("length") < LEAST_BYTES).alias("short"),
        F.count_if((kind == "audio") & ~ending.isin(*AUDIO_TYPES)).alias("bad_audio"),
        F.count_if((kind == "video") & ~ending.isin(*VIDEO_TYPES)).alias("bad_video"),
    )
    pair = (F.col("images") == 1) & (F.col("audios") == 1)
    reason = (
        F.when((F.col("videos") > 0) & (F.col("images") + F.col("audios") > 0), "video together with image or audio")
        .when((F.col("videos") != 1) & ~pair, "needs one video, or one image and one audio")
        .when(F.col("short") > 0, "file too short")
        .when(F.col("bad_audio") > 0, "audio type")
        .when(F.col("bad_video") > 0, "video type")
    )
    return sums.select("lesson_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def scan_media_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a folder <lesson>/<kind>.<type> from paths and lengths; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return manifest_rows(files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("lesson_id"), "path", F.regexp_extract("path", r"([^/.]+)\.[^/.]+$", 1).alias("kind"), "length"))


def probe_times(lines: DataFrame) -> DataFrame:
    """video_id, ts of packet lines (video_id, value) whose last cell holds K: the first cell that is a number."""
    cells = F.split("value", ",")
    return lines.filter(F.contains(F.element_at(cells, -1), F.lit("K"))).select("video_id", _first_number(cells).alias("ts")).filter("ts is not null")


def _first_number(cells: Column) -> Column:
    """The first cell that is a floating-point number in any notation."""
    plain = lambda c: F.when(F.rlike(c, F.lit(NUMBER)), F.trim(c).try_cast("double"))
    return F.get(F.filter(F.transform(cells, plain), lambda v: v.isNotNull()), F.lit(0))


def iframe_times(lines: DataFrame) -> DataFrame:
    """video_id, ts of frame lines whose picture type is I."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    return lines.filter(F.array_contains(cells, "I")).select("video_id", _first_number(cells).alias("ts")).filter("ts is not null")


def probe_times_or_iframes(packets: DataFrame, frames: DataFrame) -> DataFrame:
    """Packet times, and frame times of videos without any packet row."""
    times = probe_times(packets)
    return times.unionByName(iframe_times(frames).join(times.select("video_id").distinct(), "video_id", "left_anti"))


def scan_probe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Packet times from dumps named <video>.csv."""
    return probe_times(_named_lines(spark, path))


#: A folder whose files hold the lines of many videos each, led by the video and a tab.
PACKED = "packed"


def _named_lines(spark: SparkSession, path: str) -> DataFrame:
    """video_id, value: the lines of text files <video>.csv, of the files in folders video=<video>, or of files in a folder ``packed``; large files by many tasks."""
    files = spark.read.option("recursiveFileLookup", True).text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/video=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    packed = F.rlike(F.col("_metadata.file_path"), F.lit(rf"/{PACKED}/[^/]*$"))
    at = F.instr("value", "\t")
    video = F.when(packed, F.left("value", at - 1)).when(folder != "", folder).otherwise(name)
    return files.select(video.alias("video_id"), F.when(packed, F.substring(F.col("value"), at + 1, F.length("value"))).otherwise(F.col("value")).alias("value"))


def scan_pcm_windows(spark: SparkSession, path: str, window_sec: float = 0.1, rate: int = 16_000, part_bytes: int = 64 << 20) -> DataFrame:
    """clip_id, window_no, n, sum_sq of 16-bit WAV files; a task reads some ``part_bytes`` of them, so a long file is read by several tasks, each a run of whole windows."""
    spark.dataSource.register(PcmWindows)
    return spark.read.format(PcmWindows.name()).option("rate", rate).option("windowSec", window_sec).option("partBytes", part_bytes).load(path)


def write_pcm(samples: DataFrame, path: str, rate: int = 16_000) -> DataFrame:
    """Writes a mono WAV file <clip_id>.wav for each clip of samples (clip_id, i, v: 16-bit numbers); gives clip_id, n of what was written.

    Rows of a clip are sorted and go to its file as they come, none is held. A file gets its name once it is whole, so
    a task that is lost and runs again leaves no half of one. ``path`` is a folder that all executors share.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(path)
        system.create_dir(folder)
        out, name, clip, done = None, "", None, []

        def close() -> None:
            out.close()
            system.move(name, f"{folder}/{clip[0]}.wav")
            done.append(clip)

        for b in batches:
            clips, sizes, values = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy().astype("<i2")
            edges = [0, *(np.flatnonzero(clips[1:] != clips[:-1]) + 1).tolist(), len(clips)]
            for x, y in zip(edges, edges[1:], strict=False):
                if clip is None or clips[x] != clip[0]:
                    if out:
                        close()
                    clip, name = (int(clips[x]), int(sizes[x])), f"{folder}/.{clips[x]}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * clip[1], b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * clip[1]))
                out.write(values[x:y].tobytes())
        if out:
            close()
        yield pa.record_batch([pa.array([c for c, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=["clip_id", "n"])

    sizes = samples.groupBy("clip_id").agg(F.count("*").alias("n"))
    rows = samples.join(sizes, "clip_id").select(F.col("clip_id").cast("long").alias("clip_id"), "n", "i", F.col("v").cast("int").alias("v"))
    return rows.repartition("clip_id").sortWithinPartitions("clip_id", "i").mapInArrow(write, "clip_id long, n long")


def scan_iframe_csv(spark: SparkSession, path: str) -> DataFrame:
    """I-frame times from frame dumps named <video>.csv."""
    return iframe_times(_named_lines(spark, path))


def scan_probe_csv_or_iframes(spark: SparkSession, packets: str, frames: str) -> DataFrame:
    """Packet times of the dumps in one folder, and I-frame times of videos without any from the dumps in another."""
    return probe_times_or_iframes(_named_lines(spark, packets), _named_lines(spark, frames))
