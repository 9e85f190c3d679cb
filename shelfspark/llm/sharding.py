"""Sharding by size-tiered compaction, with DataFrame functions only.

A dataset is a folder of immutable shard files and of versioned manifests:

* ``append`` writes an arrival as small shards, as its scan deals the rows (no
  shuffle), and commits a manifest that lists them besides the older shards;
* ``split`` cuts arrivals of twice the target size or more by their row positions, so
  that a large scan task or row group does not become one shard;
* ``compact`` splits, then groups shards of one size tier into runs of about the target size,
  writes each run as one file and commits a manifest in which the new shard
  takes the place of its sources;
* a commit renames a complete manifest folder to ``manifest/v=<version>``.
  The rename fails if that version exists, so of two writers one wins and no
  reader ever sees half a version.  The other one applies its change to the newer
  version and tries the next number; a compaction whose sources are gone by
  then gives up, and its files are never listed.  Old files stay until ``vacuum``.

The file system must rename folders atomically.  Sizes are those of the files, known without reading a row.
Manifests are DataFrames: the shards of a 100 TB corpus never pass the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, small_enough, write_table

MANIFEST = "shard string, rows long, bytes long, tier int, schema string, created int"
#: Size tiers: a shard of tier t holds BASE * FANOUT^t to BASE * FANOUT^(t+1) bytes.
BASE, FANOUT = 1 << 20, 4
#: Running sums are taken over blocks of this many shards, then over the blocks.
BLOCK = 4096
#: Age from which folders that no version ever listed are taken as left over from failed writers.
ORPHAN_SECONDS = 7 * 86_400


class ShardStore:
    """A folder of shards and manifests, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 256 << 20):
        self.spark, self.path, self.target_bytes = spark, path.rstrip("/"), target_bytes

    # -- manifests ---------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(where):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(where)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the newest by default); empty before the first commit."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={version or known[-1]}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Publish ``shards`` as ``version``; raises if another writer has done so."""
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        shards.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(staged)
        source, fs = self._fs(staged)
        target, _ = self._fs(f"{self.path}/manifest/v={version}")
        fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        options = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(source), fs.makeQualified(target), none)
        return version

    def publish(self, added: DataFrame, gone: DataFrame | None = None) -> int:
        """Commit the newest version with the shards ``added`` and without those ``gone``; returns the new version.

        If another writer commits first, the change is applied to that version; raises if ``gone`` is no longer in it.
        """
        while True:
            newest = (self.versions() or [0])[-1]
            shards = self.manifest(newest or None)
            if gone is not None:
                if not gone.join(shards, "shard", "left_anti").isEmpty():
                    raise RuntimeError("another writer has replaced these shards")
                shards = shards.join(gone, "shard", "left_anti")
            try:
                return self._commit(shards.unionByName(added.withColumn("created", F.lit(newest + 1))), newest + 1)
            except Exception:
                if newest + 1 not in self.versions():
                    raise

    # -- rows --------------------------------------------------------------

    def _files(self, folder: str) -> DataFrame:
        """One manifest row per file below ``folder``, from file facts and row counts of the footers."""
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        per = rows.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)) / BASE) / F.log(F.lit(float(FANOUT)))))
        found = per.agg(F.count("*").alias("rows"))
        return found.select(F.concat(F.lit(f"{folder}/"), "file").alias("shard"), "rows", "bytes", tier.cast("int").alias("tier"), F.lit(rows.schema.json()).alias("schema"))

    def _schema(self, shards: DataFrame, *more: T.StructType) -> T.StructType:
        """All columns of ``shards`` and ``more``, matched by name, those of older shards first; raises where types differ."""
        known = shards.groupBy("schema").agg(F.min("created").alias("first")).orderBy("first", "schema").collect()  # a row for each way to lay out columns
        fields: dict[str, T.StructField] = {}
        for schema in [T.StructType.fromJson(json.loads(r.schema)) for r in known] + list(more):
            for f in schema.fields:
                held = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True, f.metadata))
                if held.dataType != f.dataType:
                    raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, but {held.dataType.simpleString()} in older shards")
        return T.StructType(list(fields.values()))

    def _rows(self, shards: DataFrame, schema: T.StructType) -> DataFrame:
        """The rows of the folders of ``shards``; where a file lacks a column, it is null."""
        folders = [r[0] for r in shards.select(F.substring_index("shard", "/", 2)).distinct().collect()]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _shard_name(self):
        """The manifest's name of the file that a row is read from."""
        return F.concat_ws("/", *[F.element_at(F.split(F.input_file_name(), "/"), -k) for k in (3, 2, 1)])

    def append(self, df: DataFrame) -> int:
        """Write an arrival as small shards and commit them; returns the version.

        Its columns may be others than those of older shards, but not of other types.
        """
        self._schema(self.manifest(), df.schema)
        folder = f"shards/a-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self.publish(self._files(folder))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``shard``: the file that holds the row.

        Arrivals may add, lack or reorder columns: the rows have the columns of all of them, and null where their own
        arrival had none.  A semi join with the manifest leaves out files of other versions.
        """
        known = self.manifest(version)
        if known.isEmpty():
            raise ValueError("no version has been committed")
        rows = self._rows(known, self._schema(known))
        named = rows.withColumn("shard", self._shard_name())
        live = known.select(F.col("shard").alias("_live"))
        live = F.broadcast(live) if small_enough(live) else live
        return named.join(live, named["shard"] == live["_live"], "left_semi")

    # -- compaction --------------------------------------------------------

    def plan(self, version: int | None = None) -> DataFrame:
        """Runs to merge: ``shard`` and ``run``, numbered from 0.

        Within a tier, shards in order of age are cut into runs where the running sum of bytes passes
        a multiple of the target size.  Runs of a single shard and shards of the target size or more stay.
        """
        size, order = F.col("bytes"), ["tier", "created", "shard"]
        small = self.manifest(version).filter(size < self.target_bytes)
        parted = small.orderBy(*order).withColumn("_part", F.spark_partition_id())
        number = F.row_number().over(Window.partitionBy("tier", "_part").orderBy(*order))
        blocks = write_table(parted.withColumn("_block", F.floor((number - 1) / BLOCK)), "shard-blocks")
        key = ["tier", "_part", "_block"]
        earlier = Window.partitionBy("tier").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = blocks.groupBy(*key).agg(F.sum(size).alias("_sum"))
        offsets = offsets.select(*key, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(*key).orderBy("created", "shard").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col("_before")
        cut = blocks.join(offsets, key).withColumn("_cut", F.floor(begin / self.target_bytes))
        many = cut.groupBy("tier", "_cut").count().filter("count > 1")
        # one row per target-sized run: few next to the rows of the corpus
        runs = many.select("tier", "_cut", (F.row_number().over(Window.orderBy("tier", "_cut")) - 1).alias("run"))
        return cut.join(runs, ["tier", "_cut"]).select("shard", "run")

    def split(self) -> int:
        """Cut shards of twice the target size or more into pieces of about that size; returns the newest version.

        A shard is cut into even numbers of rows.  Pieces that are still too large, where long texts gather, are
        cut again, so at the end only a single row is ever that large.
        """
        while True:
            newest = (self.versions() or [0])[-1]
            every = self.manifest(newest or None)
            large = every.filter((F.col("bytes") >= 2 * self.target_bytes) & (F.col("rows") > 1))
            pieces = F.least(F.floor(F.col("bytes") / self.target_bytes), "rows")
            before = F.coalesce(F.sum("pieces").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            named = large.select("shard", F.col("rows").alias("of"), pieces.alias("pieces"))
            named = write_table(named.withColumn("first", before), "shard-pieces")
            top = named.agg(F.sum("pieces")).first()[0]
            if top is None:
                drop_table(named)
                return newest
            row, at = F.struct("*").alias("row"), F.col("_metadata.row_index").alias("at")
            rows = self._rows(named, self._schema(every)).select(row, at, self._shard_name().alias("shard"))
            cut = rows.join(F.broadcast(named) if small_enough(named) else named, "shard")
            piece = F.col("first") + F.floor(F.col("at") * F.col("pieces") / F.col("of"))
            self._replace(cut.select("row", piece.alias("to")), int(top), "s", named.select("shard"))
            drop_table(named)

    def _replace(self, rows: DataFrame, count: int, kind: str, gone: DataFrame) -> int:
        """Write ``rows`` (``row``, ``to``) as ``count`` files that take the place of the shards ``gone``."""
        folder = f"shards/{kind}-{uuid.uuid4().hex}"
        moved = rows.repartitionById(count, F.col("to").cast("int")).select("row.*")
        moved.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self.publish(self._files(folder), gone)

    def compact(self) -> int:
        """Split what is too large, merge the planned runs and commit; returns the newest version."""
        newest = self.split()
        plan = write_table(self.plan(newest or None), "shard-plan")
        top = plan.agg(F.max("run")).first()[0]
        if top is not None:
            runs = plan.select(F.col("shard").alias("_merged"), F.col("run").alias("to"))
            rows = self.read(newest)
            own = [c for c in rows.columns if c != "shard"]
            rows = rows.select(F.struct(*own).alias("row"), "shard")
            moved = rows.join(F.broadcast(runs) if small_enough(runs) else runs, F.col("shard") == F.col("_merged")).select("row", "to")
            newest = self._replace(moved, int(top) + 1, "m", plan.select("shard"))
        drop_table(plan)
        return newest

    def vacuum(self, keep_versions: int = 1, orphan_seconds: int = ORPHAN_SECONDS) -> int:
        """Drop all but the newest versions and delete the folders that only dropped ones list; returns how many.

        A folder that no version has listed may belong to a writer that has yet to commit: it goes only when it is older
        than ``orphan_seconds``.
        """
        versions = self.versions()
        folders = lambda v: {r[0] for r in self.manifest(v).select(F.substring_index("shard", "/", 2)).distinct().collect()}
        live = set().union(*map(folders, versions[-keep_versions:]))
        dropped = set().union(*map(folders, versions[:-keep_versions]))
        where, fs = self._fs(f"{self.path}/shards")
        gone = 0
        for status in fs.listStatus(where) if fs.exists(where) else []:
            name = f"shards/{status.getPath().getName()}"
            old = time.time() - status.getModificationTime() / 1000 > orphan_seconds
            if name not in live and (name in dropped or old):
                fs.delete(status.getPath(), True)
                gone += 1
        for v in versions[:-keep_versions]:
            old, fs = self._fs(f"{self.path}/manifest/v={v}")
            fs.delete(old, True)
        return gone


def shard_documents(df: DataFrame, path: str, target_bytes: int = 256 << 20) -> DataFrame:
    """Append ``df`` to the store at ``path``, compact it and read the newest version back.

    Adds ``shard``, the file of each row.  Every row is written once per version, nulls and repeated rows included; texts
    of any length stay whole; an empty table commits a version without rows.  Other columns pass through
    whatever their names, but ``shard``, which is replaced.
    """
    store = ShardStore(df.sparkSession, path, target_bytes)
    clean = df.drop(*[c for c in df.columns if c.lower() == "shard"])
    store.append(clean)
    version = store.compact()
    if store.manifest(version).isEmpty():
        return clean.limit(0).withColumn("shard", F.lit(None).cast("string"))
    store.vacuum(keep_versions=2)  # a reader of the version before may be at work
    return store.read(version)
