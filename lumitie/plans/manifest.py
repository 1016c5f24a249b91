"""What of the survey has been ingested: pixels committed per band, with a fingerprint of the inputs.

Ingest works through the pixels that no commit of the same inputs covers, a group at a time: the group's detections replace its
partitions, then the group's pixels are appended to the manifest.  A run that breaks off leaves its finished groups
committed, and the next run takes up the rest; changed inputs or cuts start anew.
"""

from __future__ import annotations

import hashlib
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumitie.sources import tables as T

log = logging.getLogger("lumitie")
#: Rounds over what is missing before a run gives up.
ATTEMPTS = 3
STRUCT = "healpix_pixel bigint, n_detections bigint, fingerprint string"


def fingerprint(spark: SparkSession, paths: list[str], settings: object) -> str:
    """Digest of the names, sizes and times of all input files, read by Spark from their listing, and of the settings."""
    parts = [repr(settings)]
    for path in sorted(paths):
        if not T.exists(spark, path):
            parts.append(f"{path.rsplit('/', 1)[-1]}: none")
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime")))).first()
        parts.append(f"{path.rsplit('/', 1)[-1]}: {row[0]} {row[1]} {row[2]}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class Manifest:
    """The commits of one band."""

    def __init__(self, spark: SparkSession, path: str, mark: str):
        self.spark, self.path, self.mark = spark, path, mark

    def committed(self) -> DataFrame:
        """healpix_pixel, n_detections of the pixels ingested from these inputs; one row each, the last commit's."""
        if not T.exists(self.spark, self.path):
            return self.spark.createDataFrame([], "healpix_pixel bigint, n_detections bigint")
        rows = T.read(self.spark, self.path, STRUCT).where(F.col("fingerprint") == self.mark)
        return rows.groupBy("healpix_pixel").agg(F.max("n_detections").alias("n_detections"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        return wanted.select("healpix_pixel").distinct().join(self.committed().select("healpix_pixel"), "healpix_pixel", "left_anti")

    def commit(self, counts: DataFrame) -> None:
        """Append pixels with their number of detections; the write is one atomic job, made after their data is in place."""
        (counts.select(F.col("healpix_pixel").cast("bigint"), F.col("n_detections").cast("bigint"), F.lit(self.mark).alias("fingerprint"))
         .coalesce(1).write.mode("append").parquet(self.path))


def ingest(manifest: Manifest, wanted: DataFrame, detections, struct, path: str, group: int | None = None, attempts: int = ATTEMPTS) -> int:
    """Bring every wanted pixel into ``path``; returns how many pixels this call has ingested.

    ``detections`` makes the detections of a table of pixels.  The list of wanted pixels is that of a pixelisation of fixed
    resolution, so the driver may hold it.  A failing group is tried again in the next round; after the last round its
    failure is raised, or the pixels still missing are.
    """
    spark, done, failure = manifest.spark, 0, None
    for attempt in range(1, attempts + 1):
        left = sorted(r[0] for r in manifest.missing(wanted).collect())
        if not left:
            return done
        log.info("%s: %d pixels missing, round %d of %d", path, len(left), attempt, attempts)
        failure = None
        size = group or len(left)
        for at in range(0, len(left), size):
            pixels = left[at:at + size]
            table = spark.createDataFrame([(p,) for p in pixels], "healpix_pixel bigint")
            try:
                # nothing of an uncommitted pixel counts, so what an earlier run left of it goes
                T.drop_pixels(spark, path, pixels)
                T.write_pixels(T.pad_columns(detections(table), struct), path)
                found = T.read_pixels(spark, path, struct, pixels).groupBy("healpix_pixel").agg(F.count(F.lit(1)).alias("n_detections"))
                manifest.commit(table.join(found, "healpix_pixel", "left").na.fill(0, ["n_detections"]))
                done += len(pixels)
            except Exception as error:  # noqa: BLE001 - any failure of a group is tried again, and raised in the end
                failure = error
                log.warning("pixels %s...: %s", pixels[:3], error)
    left = manifest.missing(wanted).count()
    if failure is not None:
        raise failure
    if left:
        raise RuntimeError(f"{left} pixels still missing after {attempts} rounds")
    return done
