"""Stored samples by definition, and their re-decoding when definitions change.

Samples lie in Parquet, partitioned by the version that wrote them and by definition. A manifest for each version says which
version holds each definition; a reader takes the newest manifest that is complete. So a change writes the
partitions of changed definitions and then one small table: until that is there readers see the old samples as a whole,
after it the new ones, and no file that anybody reads is ever touched. (Overwriting partitions in place could neither take
out a definition nor be seen at once.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import decode, small, spread
from .definitions import changed_definitions, keys_to_decode


#: Frames of which a task decodes and sorts the samples, about.
TASK_FRAMES = 100_000


def dealt(frames: DataFrame, rows: int = TASK_FRAMES) -> DataFrame:
    """``frames`` in tasks of some ``rows``: a task sorts its samples by definition to write them, and a split of a file may hold millions of frames."""
    tasks = -(-frames.count() // rows)
    return frames.repartition(tasks, "ordinal") if tasks > frames.sparkSession.sparkContext.defaultParallelism else spread(frames)


class SampleStore:
    """``path`` is a folder that the driver and all executors share; ``samples`` have a ``def_id``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int | None:
        """The newest version whose manifest is complete."""
        files, path = self._folder("manifest")
        if not files.exists(path):
            return None
        names = [s.getPath().getName() for s in files.listStatus(path)]
        done = [int(n.split("=")[1]) for n in names if n.startswith("v=") and files.exists(self._folder(f"manifest/{n}/_SUCCESS")[1])]
        return max(done, default=None)

    def manifest(self) -> DataFrame:
        """``def_id, v``: which version holds each definition's samples."""
        return self.spark.read.schema("def_id string, v int").parquet(f"{self.path}/manifest/v={self.version()}")

    def _publish(self, manifest: DataFrame, version: int) -> None:
        manifest.select("def_id", F.col("v").cast("int")).coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")

    def _write(self, samples: DataFrame, version: int) -> None:
        samples.select(*[c for c in samples.columns if c != "def_id"], "def_id").write.partitionBy("def_id").parquet(f"{self.path}/samples/v={version}")

    def create(self, samples: DataFrame) -> SampleStore:
        """Version 0 with all samples; the folder must be new."""
        self._write(samples, 0)
        self.spark.createDataFrame([(samples.schema.json(),)], "text string").coalesce(1).write.text(f"{self.path}/schema")
        self._publish(self._all(samples.schema).select("def_id", "v").distinct(), 0)
        return self

    def _schema(self):
        from pyspark.sql.types import StructType
        import json

        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    def _all(self, schema) -> DataFrame:
        from pyspark.sql.types import IntegerType, StringType, StructField, StructType

        fields = [f for f in schema.fields if f.name != "def_id"]
        stored = StructType([*fields, StructField("v", IntegerType()), StructField("def_id", StringType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/samples").parquet(f"{self.path}/samples")

    def read(self, def_ids: DataFrame | None = None) -> DataFrame:
        """All samples of the newest version, or those of some definitions; other partitions are pruned."""
        wanted = self.manifest() if def_ids is None else self.manifest().join(small(def_ids.select("def_id").distinct()), "def_id", "left_semi")
        schema = self._schema()
        return self._all(schema).join(small(wanted), ["v", "def_id"], "left_semi").select(*schema.fieldNames())

    def replace(self, fresh: DataFrame, changed: DataFrame) -> int:
        """The samples of ``changed(def_id)`` become ``fresh``, which may have none for some; all others stay. Gives the version."""
        now = self.version()
        version = now + 1
        fresh = fresh.select(*self._schema().fieldNames())
        self._write(fresh.join(small(changed.select("def_id").distinct()), "def_id", "left_semi"), version)
        written = self._all(self._schema()).filter(F.col("v") == version).select("def_id", "v").distinct()
        kept = self.manifest().join(small(changed.select("def_id").distinct()), "def_id", "left_anti")
        self._publish(kept.select("def_id", "v").union(written), version)
        return version

    def vacuum(self) -> None:
        """Deletes what the newest manifest does not name. No reader of an older version may still run."""
        used = {(r["v"], r["def_id"]) for r in self.manifest().toLocalIterator()}
        now = self.version()
        files, path = self._folder("samples")
        for version in files.listStatus(path):
            number = int(version.getPath().getName().split("=")[1])
            if not any(v == number for v, _ in used) and number != now:
                files.delete(version.getPath(), True)
        for manifest in files.listStatus(self._folder("manifest")[1]):
            if int(manifest.getPath().getName().split("=")[1]) != now:
                files.delete(manifest.getPath(), True)


def whole_definitions(layouts: DataFrame) -> DataFrame:
    """``def_id, rows``: each definition as one row, all its signals as sorted texts, fit for ``changed_definitions``."""
    row = F.to_json(F.struct(*sorted(c for c in layouts.columns if c != "def_id")))
    return layouts.groupBy("def_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def redecode(store: SampleStore, frames: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Brings a store of ``old`` layouts' samples to ``new`` ones; ``def_id`` of all definitions whose samples were made anew.

    Changed definitions name the CAN keys to decode again: those they had and those they have. As one definition of a key
    hides another, all definitions of these keys are made anew, from the frames of these keys alone; the result equals decoding everything.
    """
    changed = changed_definitions(whole_definitions(old), whole_definitions(new))
    keys = keys_to_decode(old.select("def_id", "can_id", "extended").distinct(), new.select("def_id", "can_id", "extended").distinct(), changed)
    both = old.select("def_id", "can_id", "extended").union(new.select("def_id", "can_id", "extended"))
    touched = both.join(small(keys), ["can_id", "extended"], "left_semi").select("def_id").distinct()
    layouts = new.join(small(keys), ["can_id", "extended"], "left_semi")
    fresh = decode(dealt(frames.join(small(keys), ["can_id", "extended"], "left_semi")), layouts, True)
    store.replace(fresh, touched)
    return touched
