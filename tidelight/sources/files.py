"""Spectrum files: discovery, decoding and content checks, all as Spark scans."""

from __future__ import annotations

import gzip
import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight import fixed, schemas
from tidelight.functions.times import file_interval
from tidelight.operators.guards import DataError

GLOB = "*.{fft,fft.gz}"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name and size of the spectrum files; only metadata is read. An empty folder is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)
    out = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if out.isEmpty():
        raise DataError(f"no spectrum files under {folder}")
    return out


def readable(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("length") > 0).alias("n_readable"))


def _payload(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == fixed.GZIP_MAGIC else raw


#: What a byte of a file may be: 1 a digit, 2 white space, 3 a minus sign, 0 anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"0123456789")], _KIND[list(b" \t\n\r\v\f")], _KIND[ord("-")] = 1, 2, 3
_DIGITS = 5  # digits of the largest small integer


def _whole_numbers(text: bytes) -> np.ndarray | None:
    """The numbers of a text of whole numbers and white space, digit by digit over all numbers at once; None if it holds anything else."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    if not len(raw) or not kind.all():
        return None
    digit = np.zeros(len(raw) + 2, bool)
    digit[1:-1] = kind == 1
    edges = np.flatnonzero(digit[1:] != digit[:-1])  # numbers begin and end in turn
    begin, end = edges[::2], edges[1::2]
    length = (end - begin).astype(np.int8) if len(end) and (end - begin).max() <= _DIGITS else None
    if length is None:
        return None
    digits = raw & np.uint8(15)
    value = digits[end - 1].astype(np.int32)
    for k in range(1, int(length.max())):
        value += np.where(length > k, digits[end - 1 - k], 0).astype(np.int32) * np.int32(10**k)
    minus = np.flatnonzero(kind == 3)
    if len(minus):  # a sign stands before a number and behind white space
        signed = np.searchsorted(begin, minus + 1)
        if (minus == len(raw) - 1).any() or not np.array_equal(begin[np.minimum(signed, len(begin) - 1)], minus + 1) or (kind[minus[minus > 0] - 1] != 2).any():
            return None
        value[signed] *= -1
    return value


def _levels(raw: bytes, n_frames: int, n_bins: int) -> np.ndarray:
    """All levels of a file in row-major order, as small integers."""
    text = _payload(raw)
    values = _whole_numbers(text)
    if values is None:  # fractions, exponents, long numbers or something that is no number
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # text that is not a number must not end the scan quietly
            try:
                values = np.fromstring(text, dtype=np.float64, sep=" ")
            except (DeprecationWarning, ValueError) as exc:
                raise ValueError("holds text that is not a number") from exc
    if values.size != n_frames * n_bins:
        raise ValueError(f"holds {values.size} values, expected {n_frames * n_bins}")
    if values.dtype == np.int32 and -(1 << 15) <= values.min() and values.max() < 1 << 15:
        return values.astype(np.int16)
    if not np.isfinite(values).all():
        raise ValueError("holds values that are not finite")
    out = values.astype(np.int16)
    if not np.array_equal(out, values):
        raise ValueError("holds values that are not small integers")
    return out


def decode(files: DataFrame, device: str, n_frames: int = fixed.N_FRAMES, n_bins: int = fixed.N_BINS,
           frame_s: float = fixed.FRAME_SECONDS) -> DataFrame:
    """binaryFile rows (path, content) -> one row per frame, or one row with a ``reason`` per bad file.

    The container is told by its first bytes, never by its name; the start time comes from the name.
    Use ``frames_of`` and ``errors_of`` on the written result, so that files are decoded once.
    """
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", file_interval(name, device).alias("f"), "content").select(
        "path", "content", F.unix_micros("f.start_utc").alias("us"), F.col("f.problem").alias("problem"))
    fields = pa.schema([("path", pa.string()), ("us", pa.int64()), ("frame_idx", pa.int32()), ("levels", pa.list_(pa.int16())), ("reason", pa.string())])
    frame_idx = np.arange(n_frames, dtype=np.int32)
    offsets = pa.array(np.arange(n_frames + 1, dtype=np.int32) * n_bins)

    def one(path: str, content: bytes, us: int | None, reason: str | None) -> pa.RecordBatch:
        if reason is None:
            try:
                levels = pa.ListArray.from_arrays(offsets, pa.array(_levels(content, n_frames, n_bins)))
                same = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(n_frames, np.int32)))
                return pa.RecordBatch.from_arrays(
                    [same(path, pa.string()), same(us, pa.int64()), pa.array(frame_idx), levels, pa.nulls(n_frames, pa.string())], schema=fields)
            except (ValueError, OSError, EOFError) as exc:
                reason = f"{type(exc).__name__}: {exc}"
        return pa.RecordBatch.from_pylist([{"path": path, "us": us, "frame_idx": None, "levels": None, "reason": reason}], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a whole file
                yield one(*(batch.column(c)[i].as_py() for c in ("path", "content", "us", "problem")))

    out = named.mapInArrow(run, "path string, us bigint, frame_idx int, levels array<smallint>, reason string")
    return out.select("path", F.timestamp_micros("us").alias("start_utc"), "frame_idx",
                      (F.col("us") / F.lit(1e6) + F.col("frame_idx") * F.lit(frame_s)).alias("t_utc_s"), "levels", "reason")


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)
            .select("path", "content"))


def frames_of(decoded: DataFrame, device: str) -> DataFrame:
    good = decoded.where("reason IS NULL").withColumn("device", F.lit(device))
    return good.select(*schemas.FRAMES.fieldNames())


def errors_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("reason IS NOT NULL").select("path", "reason")


def content_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of the decompressed bytes of every file; a broken gzip stream carries a reason instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in pdf.itertuples(index=False):
                try:
                    rows.append((path, hashlib.sha256(_payload(bytes(content))).hexdigest(), None))
                except (OSError, EOFError) as exc:
                    rows.append((path, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["path", "sha256", "reason"])

    return files.select("path", "content").mapInPandas(run, "path string, sha256 string, reason string")


def hash_mismatches(hashes: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files whose hash is missing, broken or different from the recorded one."""
    j = hashes.join(sidecars.withColumnRenamed("sha256", "recorded"), "path", "full")
    why = (F.when(F.col("recorded").isNull(), "no_record").when(F.col("sha256").isNull() & F.col("reason").isNull(), "no_file")
           .when(F.col("reason").isNotNull(), "broken_container").when(F.col("sha256") != F.col("recorded"), "different"))
    return j.withColumn("finding", why).where("finding IS NOT NULL").select("path", "finding")
