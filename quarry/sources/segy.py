"""SEG-Y volumes as a batch data source of the Python Data Source API.

Layout from the public SEG-Y standard: 3200 bytes of text header, 400 of binary
header (sample interval at 17-18, samples a trace at 21-22, format at 25-26),
then traces of 240 header bytes (inline at 189-192, crossline at 193-196) and
big-endian samples (format 1 IBM floats, 5 IEEE floats).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

TEXT, BINARY, HEAD = 3200, 400, 240


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """IBM 32-bit hexadecimal floats as doubles."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    exponent = ((raw >> 24) & 0x7F).astype(np.int64) - 64
    return sign * (raw & 0xFFFFFF).astype(np.float64) / 2.0**24 * 16.0**exponent


def float_to_ibm(values: np.ndarray) -> np.ndarray:
    """Doubles as IBM 32-bit hexadecimal floats."""
    out = np.zeros(len(values), np.uint32)
    for i, v in enumerate(np.asarray(values, float)):
        if v:
            e = int(np.ceil(np.log2(abs(v)) / 4 + 1e-12))
            frac = abs(v) / 16.0**e
            while frac >= 1:
                frac, e = frac / 16, e + 1
            out[i] = (np.uint32(0x80000000) if v < 0 else np.uint32(0)) | np.uint32((e + 64) & 0x7F) << np.uint32(24) | np.uint32(min(int(round(frac * 2**24)), 2**24 - 1))
    return out


def _file_head(n: int, interval_us: int) -> bytes:
    head = bytearray(BINARY)
    struct.pack_into(">hxxhxxh", head, 16, interval_us, n, 1)
    return b" " * TEXT + head


def _trace(il: int, xl: int, samples: np.ndarray, interval_us: int, kind: int = 1) -> bytes:
    """A trace with its header; format 1 is IBM floats, 5 IEEE floats."""
    head = bytearray(HEAD)
    struct.pack_into(">ii", head, 188, il, xl)
    struct.pack_into(">hh", head, 114, len(samples), interval_us)
    return bytes(head) + (samples.astype(">f4") if kind == 5 else float_to_ibm(samples).astype(">u4")).tobytes()


def write_segy(path: str, lines: list[tuple[int, int, list[float]]], interval_us: int = 4000) -> None:
    """A small volume of (inline, crossline, samples), sorted by inline, in IBM floats."""
    n = len(lines[0][2])
    if any(len(s) != n for _, _, s in lines):
        raise ValueError("traces differ in length")
    with open(path, "wb") as f:
        f.write(_file_head(n, interval_us))
        for il, xl, samples in sorted(lines, key=lambda t: t[:2]):
            f.write(_trace(il, xl, np.array(samples), interval_us))


def write_attribute(traces: DataFrame, path: str, reference: str | None = None, interval_ms: float = 4.0) -> None:
    """``il, xl, samples`` as SEG-Y files of inline ranges in a folder, sorted by inline and crossline."""
    rows = traces.select("il", "xl", "samples").repartitionByRange("il").sortWithinPartitions("il", "xl")
    out = rows.write.format("segy").mode("append").option("intervalMs", interval_ms)
    (out.option("reference", reference) if reference else out).save(path)


@dataclass
class _Layout:
    """What the headers of a file say, and how many traces it has."""

    interval: float
    n: int
    kind: int
    traces: int

    @classmethod
    def of(cls, path: str) -> _Layout:
        with open(path, "rb") as f:
            head = f.read(TEXT + BINARY)
            f.seek(0, 2)
            size = f.tell()
        interval, n, kind = struct.unpack_from(">h2xh2xh", head, TEXT + 16)
        return cls((interval or 4000) / 1000.0, n, kind, (size - TEXT - BINARY) // (HEAD + 4 * n) if n > 0 else 0)


class _Traces(InputPartition):
    def __init__(self, path: str, first: int, count: int, layout: _Layout) -> None:
        self.path, self.first, self.count, self.layout = path, first, count, layout


class SegyReader(DataSourceReader):
    """Partitions are ranges of traces of a file, or of the files of a folder; each task seeks to its own.

    Files must be on a file system that is mounted on every worker.
    """

    def __init__(self, path: str, per_part: int) -> None:
        self.paths = sorted(str(p) for p in Path(path).iterdir() if p.suffix in (".sgy", ".segy")) if Path(path).is_dir() else [path]
        self.per_part = per_part

    def partitions(self):
        found = [(p, _Layout.of(p)) for p in self.paths]
        return [_Traces(p, i, min(self.per_part, x.traces - i), x) for p, x in found for i in range(0, x.traces, self.per_part)]

    def read(self, partition):
        x = partition.layout
        step = HEAD + 4 * x.n
        with open(partition.path, "rb") as f:
            f.seek(TEXT + BINARY + partition.first * step)
            for _ in range(partition.count):
                raw = f.read(step)
                il, xl = struct.unpack_from(">ii", raw, 188)
                if x.kind == 5:
                    samples = np.frombuffer(raw, ">f4", x.n, HEAD).astype(float)
                else:
                    samples = ibm_to_float(np.frombuffer(raw, ">u4", x.n, HEAD).astype(np.uint32))
                yield il, xl, x.interval, samples.tolist()


@dataclass
class _Part(WriterCommitMessage):
    path: str
    traces: int


class SegyWriter(DataSourceWriter):
    """One file a task, in the order of its rows: sort and range-partition by inline first.

    ``reference``: a file whose text and binary headers are copied; its number of
    traces and samples must be that of the rows, else ValueError and no file
    stays. Without one, headers say IBM floats and ``intervalMs`` (4).
    """

    def __init__(self, path: str, reference: str | None, interval_ms: float) -> None:
        self.path, self.interval_us = path, int(interval_ms * 1000)
        self.like, self.heads = None, None
        Path(path).mkdir(parents=True, exist_ok=True)
        if reference:
            self.like = _Layout.of(reference)
            self.interval_us = int(self.like.interval * 1000)
            with open(reference, "rb") as f:
                self.heads = f.read(TEXT + BINARY)

    def write(self, iterator):
        name, f, n, count = f"{self.path}/part-{TaskContext.get().partitionId():05d}.sgy", None, 0, 0
        try:
            for row in iterator:
                samples = np.array(row["samples"], float)
                if f is None:
                    n, f = len(samples), open(f"{name}.tmp", "wb")
                    f.write(self.heads or _file_head(n, self.interval_us))
                if len(samples) != n or self.like and n != self.like.n:
                    raise ValueError(f"a trace has {len(samples)} samples, not {self.like.n if self.like else n}")
                f.write(_trace(row["il"], row["xl"], samples, self.interval_us, self.like.kind if self.like else 1))
                count += 1
        finally:
            if f:
                f.close()
        return _Part(name if count else "", count)

    def commit(self, messages):
        total = sum(m.traces for m in messages if m)
        if self.like and total != self.like.traces:
            self.abort(messages)
            raise ValueError(f"{total} traces, where the reference has {self.like.traces}")
        for m in messages:
            if m and m.path:
                Path(f"{m.path}.tmp").replace(m.path)

    def abort(self, messages):
        for p in Path(self.path).glob("part-*.sgy.tmp"):
            p.unlink(missing_ok=True)


class SegyDataSource(DataSource):
    """``spark.read.format("segy").load(path)``; option ``tracesPerPartition``. See ``write_attribute`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return "il int, xl int, interval_ms double, samples array<double>"

    def writer(self, schema, overwrite):
        return SegyWriter(self.options["path"], self.options.get("reference"), float(self.options.get("intervalMs", 4.0)))

    def reader(self, schema):
        return SegyReader(self.options["path"], int(self.options.get("tracesPerPartition", 10_000)))
