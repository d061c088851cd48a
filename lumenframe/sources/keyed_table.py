"""A table of one row per key in parquet files, where a merge rewrites only the files that hold one of its keys.

Files are sorted ranges of the first key column. A manifest lists a version's files, each with its lowest and highest first key, its rows, the highest value of a mark
column, and a small filter of its keys. A merge looks up the ranges that its keys fall into, asks the filters of those files, reads and rewrites the files that are
left, and writes what belongs to none into new files. Small files are taken along when there are many of them. Nothing is changed in place: the new files come first, then a new manifest, and its success mark makes
the version. A merge that breaks off before leaves the version before it, and files that no manifest names.

A merge may carry a tag (the number of a stream's batch); a tag that the current version was made with, or one before it, is not merged again.

Keys are not null; the first key column is a number, a date, a time or a text. What comes to the driver is the manifest without its filters: a row per file of about ``file_rows`` rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.scaling import top_per_group
from lumenframe.session import scratch_path

FILE_ROWS = 1_000_000
#: Files of less than a quarter of the rows are small; more of them than this are put together by the next merge.
MANY_SMALL = 16
BITS_PER_KEY = 16


def filter_bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``size`` bits, a power of two, from halves of a 64-bit hash."""
    h = np.ascontiguousarray(hashes).view(np.uint64)
    return ((h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64))


def build_filter(hashes: np.ndarray) -> bytes:
    size = 64
    while size < min(BITS_PER_KEY * len(hashes), 1 << 31):
        size *= 2
    bits = np.zeros(size // 8, np.uint8)
    for at in filter_bits(hashes, size):
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits.tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.frombuffer(bits, np.uint8)
    a, b = filter_bits(hashes, 8 * len(held))
    return ((held[a >> 3] >> (a & 7).astype(np.uint8)) & (held[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], mark: str | None = None, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.keys, self.mark, self.file_rows = spark, root, list(keys), mark, file_rows

    # versions ------------------------------------------------------------------------------------

    def _manifests(self) -> dict[int, tuple[str, int | None]]:
        """Folder and tag of each finished version."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        files = place(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        folder = f"{self.root}/manifests"
        found = {}
        for status in files.listStatus(place(folder)) if files.exists(place(folder)) else ():
            name = status.getPath().getName()
            parts = re.fullmatch(r"v(\d+)(?:-tag(\d+))?", name)
            if parts and files.exists(place(f"{folder}/{name}/_SUCCESS")):
                found[int(parts[1])] = (f"{folder}/{name}", None if parts[2] is None else int(parts[2]))
        return found

    def versions(self) -> list[int]:
        return sorted(self._manifests())

    def tag(self) -> int | None:
        """The highest tag of all versions."""
        return max((t for _, t in self._manifests().values() if t is not None), default=None)

    def manifest(self, version: int | None = None) -> DataFrame | None:
        known = self._manifests()
        return self.spark.read.parquet(known[version or max(known)][0]) if known else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest or a given version."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        return self.spark.read.parquet(*paths)

    def high(self):
        """The highest mark, from the manifest alone."""
        listed = self.manifest()
        return None if listed is None else listed.agg(F.max("mark")).first()[0]

    # writing -------------------------------------------------------------------------------------

    def _hash(self):
        return F.xxhash64(*self.keys)

    def _write(self, rows: DataFrame) -> DataFrame:
        """Writes rows as new files and gives their manifest rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex[:12]}"
        first = self.keys[0]
        n = max(1, -(-rows.count() // self.file_rows))
        rows.repartitionByRange(n, *self.keys).sortWithinPartitions(*self.keys).write.parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        path = F.col("_metadata.file_path").alias("path")
        mark = F.max(self.mark) if self.mark else F.lit(None).cast("int")
        sizes = written.select(path, *rows.columns).groupBy("path").agg(F.min(first).alias("low"), F.max(first).alias("high"), F.count("*").alias("n"), mark.alias("mark"))

        def filters(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"path": [pdf["path"].iloc[0]], "filter": [build_filter(pdf["h"].to_numpy())]})

        made = written.select(path, self._hash().alias("h")).groupBy("path").applyInPandas(filters, "path string, filter binary")  # a file's keys
        return sizes.join(made, "path")

    def _commit(self, listed: DataFrame, tag: int | None) -> int:
        known = self.versions()
        version = known[-1] + 1 if known else 1
        name = f"v{version:06d}" + ("" if tag is None else f"-tag{tag}")
        listed.coalesce(max(1, listed.rdd.getNumPartitions() // 8)).write.mode("overwrite").parquet(f"{self.root}/manifests/{name}")
        return version

    def touched(self, source: DataFrame) -> list[str]:
        """The files of the current version that may hold a key of ``source``: by range, then by filter."""
        listed = self.manifest()
        ranges = listed.select("path", "low", "high").toPandas()  # a row per file
        ranges = ranges.sort_values("low", kind="stable").reset_index(drop=True)
        sent = self.spark.sparkContext.broadcast((ranges["path"].to_numpy(), ranges["low"].to_numpy(), ranges["high"].to_numpy()))

        def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            paths, low, high = sent.value
            for pdf in batches:
                pdf = pdf.sort_values("k", kind="stable")
                k, h = pdf["k"].to_numpy(), pdf["h"].to_numpy()
                a, b = np.searchsorted(k, low), np.searchsorted(k, high, side="right")
                some = np.flatnonzero(a < b)
                if len(some):
                    yield pd.DataFrame({"path": np.repeat(paths[some], (b - a)[some]), "h": np.concatenate([h[a[f] : b[f]] for f in some])})

        def ask(keys: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
            hit = len(keys) and len(file) and may_hold(file["filter"].iloc[0], keys["h"].to_numpy()).any()
            return pd.DataFrame({"path": file["path"].iloc[:1] if hit else []}).astype({"path": "object"})

        asked = source.select(F.col(self.keys[0]).alias("k"), self._hash().alias("h")).repartitionByRange(F.col("k")).mapInPandas(ranged, "path string, h long").distinct()
        hits = asked.groupBy("path").cogroup(listed.select("path", "filter").groupBy("path")).applyInPandas(ask, "path string")
        return [r.path for r in hits.collect()]

    def merge(self, source: DataFrame, order: Sequence[str] = (), against_target: bool = False, tag: int | None = None) -> int:
        """Puts in the best row of each key of ``source`` by ``order``; with ``against_target`` a row in the table that is better stays. Gives the version."""
        seen = self.tag()
        if tag is not None and seen is not None and tag <= seen:
            return self.versions()[-1]
        path = scratch_path(self.spark, "merge")
        top_per_group(source, self.keys, order or [self.keys[0]], 1).write.parquet(path)
        best = self.spark.read.schema(source.schema).parquet(path)
        listed = self.manifest()
        if listed is None:
            return self._commit(self._write(best), tag)
        gone = set(self.touched(best))
        small = [r.path for r in listed.where(F.col("n") < self.file_rows / 4).select("path").collect()]
        if len(small) > MANY_SMALL:
            gone |= set(small)
        rows = best
        if gone:
            old = self.spark.read.parquet(*sorted(gone)).select(*source.columns)
            if against_target:
                rows = top_per_group(old.unionByName(best), self.keys, order, 1)
            else:
                rows = old.join(best.select(*self.keys), self.keys, "left_anti").select(*source.columns).unionByName(best)
        new = self._write(rows)
        left = self.spark.createDataFrame([(p,) for p in gone], "path string")
        return self._commit(listed.join(left, "path", "left_anti").unionByName(new), tag)
