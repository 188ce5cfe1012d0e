"""A Spark data source of 16-bit PCM WAV files: byte ranges of a file are read by different tasks, aligned to analysis windows.

    spark.dataSource.register(PcmWindows)
    spark.read.format("pcm_windows").option("path", folder).option("rate", 16000).load()

Paths go through Arrow's file systems: local ones, hdfs:// and s3:// are known, with their connectors. A task holds one
run of windows at a time, never a file. Which bytes a partition reads follows from the file's size alone; the header is
read by each task of a file, so the driver reads none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER_BYTES = 1 << 16
"""Chunks in front of the samples are looked for in so many bytes; a file that holds more in front is read on in as many again."""
READ_BYTES = 1 << 22
BATCH_ROWS = 10_000
"""Windows of several clips that leave a task together, at least."""

SCHEMA = "clip_id string, window_no long, n long, sum_sq double"


@dataclass(frozen=True)
class WavLayout:
    channels: int
    rate: int
    bits: int
    start: int
    """Of the samples, in bytes."""
    size: int
    """Bytes of the samples that the file really has."""


def wav_layout(file: pa.NativeFile, path: str) -> WavLayout:
    """Finds the format and the samples; chunks of other kinds are skipped. A data chunk whose size says more than the file has, as of a recording that was cut off, ends with the file."""
    total = file.size()
    at, form = 12, None
    head = file.read_at(min(HEADER_BYTES, total), 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError(f"{path}: no WAV file")
    base = 0
    while at + 8 <= total:
        if at + 24 > base + len(head):
            base = at
            head = file.read_at(min(HEADER_BYTES, total - at), at)
        kind, size = struct.unpack_from("<4sI", head, at - base)
        if kind == b"fmt " and len(head) - (at - base) >= 24:
            form = struct.unpack_from("<HHIIHH", head, at - base + 8)
        elif kind == b"data":
            if form is None:
                break
            return WavLayout(form[1], form[2], form[5], at + 8, min(size, total - at - 8))
        at += 8 + size + (size & 1)
    raise ValueError(f"{path}: no format or no samples")


def window_sums(file: pa.NativeFile, path: str, rate: int, window_sec: float, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window_no, n, sum_sq) of the windows that begin in bytes low to high of a file's samples."""
    lay = wav_layout(file, path)
    if lay.bits != 16 or lay.rate != rate or not lay.channels:
        raise ValueError(f"{path}: 16-bit PCM at {rate} Hz is needed")
    frame = 2 * lay.channels
    samples = lay.size // frame
    size = max(1, int(rate * max(0.01, window_sec)))
    first, last = (min(-(-x // (size * frame)), -(-samples // size)) for x in (low, high))
    step = max(1, READ_BYTES // (size * frame))
    for a in range(first, last, step):
        b = min(last, a + step)
        end = min(samples, b * size)
        raw = np.frombuffer(file.read_at((end - a * size) * frame, lay.start + a * size * frame), "<i2").reshape(-1, lay.channels)
        v = (raw / 32768.0).mean(axis=1)
        at = np.arange(0, len(v), size)
        yield np.arange(a, b), np.diff(np.append(at, len(v))), np.add.reduceat(v * v, at)


@dataclass
class _Ranges(InputPartition):
    """(path, from, to) in bytes of samples; together about as many bytes as a task should read."""

    ranges: list[tuple[str, int, int]]


def packed(files: list[tuple[str, int]], part_bytes: int) -> list[_Ranges]:
    """Cuts files (path, bytes), laid end to end, into parts of so many bytes: large files lie in several parts, small ones share one."""
    out, room = [], 0
    for path, size in files:
        at = 0
        while at < max(1, size):
            if not room:
                out.append(_Ranges([]))
                room = part_bytes
            end = min(max(1, size), at + room)
            out[-1].ranges.append((path, at, end))
            room -= end - at
            at = end
    return out


def dealt(parts: list[_Ranges], tasks: int, task_bytes: int = 64 << 20) -> list[_Ranges]:
    """Neighbouring parts put together for so many tasks, or for as many more as keep each within ``task_bytes``; every range stays as it was cut."""
    if len(parts) <= tasks:
        return parts
    total = sum(high - low for p in parts for _, low, high in p.ranges)
    tasks = min(len(parts), max(tasks, -(-total // task_bytes)))
    return [_Ranges([r for p in parts[k * len(parts) // tasks : (k + 1) * len(parts) // tasks] for r in p.ranges]) for k in range(tasks)]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or address, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rate, self.window_sec = int(options.get("rate", 16_000)), float(options.get("windowsec", 0.1))
        self.part_bytes = int(options.get("partbytes", 64 << 20))
        self.tasks = int(options.get("tasks", 64))

    def partitions(self) -> list[_Ranges]:
        system, path = file_system(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return dealt(packed(sorted((f.path, f.size) for f in files if f.is_file and f.path.lower().endswith(".wav")), self.part_bytes), self.tasks)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        held, rows = [], 0  # windows of short clips go out together
        for path, low, high in partition.ranges:
            with system.open_input_file(path) as file:
                for no, n, sums in window_sums(file, path, self.rate, self.window_sec, low, high):
                    held.append((path, no, n, sums))
                    rows += len(no)
                    if rows >= BATCH_ROWS:
                        yield _batch(held)
                        held, rows = [], 0
        if held:
            yield _batch(held)


def _batch(held: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    clips = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(held), dtype=np.int32), [len(h[1]) for h in held]), pa.array([h[0] for h in held], pa.string())).dictionary_decode()
    no, n, sums = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    return pa.record_batch([clips, pa.array(no, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.float64())], names=["clip_id", "window_no", "n", "sum_sq"])


class PcmWindows(DataSource):
    """Options: path (a file or folder), rate, windowSec, partBytes (samples that a part holds), tasks (that parts are dealt over, where there are more; a task reads 64 MB at most then, or one part)."""

    @classmethod
    def name(cls) -> str:
        return "pcm_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
