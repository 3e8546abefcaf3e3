"""A table of immutable shards that grows by appending and is kept small by size-tiered compaction.

Arrivals are written as small runs and never changed. The tier of a run is the
logarithm of its measured size. Runs of one tier are merged, as soon as there are
``fan_in`` of them, into one run of target-sized files, without a shuffle; its own
size says which tier that is. What belongs to a version is named by its manifest,
a table of files; a version exists from the moment its small pointer file has its
name, and a writer that finds the name taken fails: whoever writes takes one version,
reads nothing but that one, and commits the next, so that no commit between the two
is lost. What a failed writer has written stays unnamed until it is vacuumed. That holds where a rename to
an existing name fails, as in HDFS and local folders; on an object store without
such a rename, give the table to one writer at a time. Readers of an older version
keep its files until they are vacuumed.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

ENTRY = "run string, folder string, path string, tier int, n_rows long, n_bytes long"
#: Runs smaller than this share the lowest tier.
UNIT = 1 << 20
#: Seconds that a writer may take from its first file to its commit; vacuum leaves younger files alone.
GRACE = 24 * 3600


#: Folder name of a null arrival, as Spark's writer gives it: fixed value.
NO_ARRIVAL = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardTable:
    def __init__(self, spark: SparkSession, folder: str, fan_in: int = 4, target_bytes: int = 256 << 20):
        if fan_in < 2:
            raise ValueError("fan_in must be 2 at least")
        self.spark, self.folder, self.fan_in, self.target_bytes = spark, folder.rstrip("/"), fan_in, target_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/versions")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")) if self._fs.exists(at) else []

    def _pointer(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/versions/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Files of a version, the latest by default; none before the first."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self._pointer(known[-1] if version is None else version)["entries"])

    def schema(self, version: int | None = None) -> T.StructType | None:
        known = self.versions()
        return T.StructType.fromJson(self._pointer(known[-1] if version is None else version)["schema"]) if known else None

    def _commit(self, entries: DataFrame, schema: T.StructType, version: int) -> int:
        """Write a manifest, then create its pointer: the one step that counts, and that fails if the version exists."""
        place = f"{self.folder}/manifests/{version:010d}-{uuid.uuid4().hex}"
        entries.selectExpr("run", "folder", "path", "tier", "n_rows", "n_bytes").write.parquet(place)
        body = json.dumps({"entries": place, "schema": schema.jsonValue()}).encode()
        # the body is complete before the name exists; a rename to an existing file fails
        draft, final = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/versions/{version:010d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()
        if (self.versions() or [0])[-1] >= version or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} exists")
        return version

    # writing

    def _tier(self, size) -> F.Column:
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size / F.lit(UNIT), F.lit(1.0))) / math.log(self.fan_in) + 1e-9)).cast("int")

    def _batch(self, version: int, k: int = 0) -> str:
        """A new name for a folder of runs; names sort by version, so a merge reads its runs in the order of their arrival."""
        return f"{version:010d}-{k:03d}-{uuid.uuid4().hex}"

    def _files(self, folder: str, schema: T.StructType) -> DataFrame:
        """Entries of the files below a folder; run and tier are still open."""
        files = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        one = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes"))
        return one.groupBy("path").agg(F.count("*").alias("n_rows"), F.max("n_bytes").alias("n_bytes"))

    def append(self, docs: DataFrame, arrival: F.Column | None = None, attempts: int = 1) -> int:
        """Write rows as new runs, one for each value of ``arrival``, and commit; gives the version.

        Each task writes its own small files, so nothing is shuffled. A null
        arrival is a run of its own. Without rows there is a version without new
        files. Other columns than the table's are an error. If another writer
        commits first, the files are kept and committed behind its version, for
        so many attempts in all; the last one's Conflict is raised.
        """
        known = self.versions()
        version = known[-1] if known else 0
        schema = self.schema(version) if known else docs.schema
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in docs.schema]:
            raise ValueError("columns differ from the table's")
        batch = self._batch(version + 1)
        place, key = f"{self.folder}/data/{batch}", f"_run_{batch[-8:]}"
        docs.withColumn(key, (arrival if arrival is not None else F.lit(0)).cast("string")).write.option("compression", "zstd").partitionBy(key).parquet(place)
        new = self._files(place, schema).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("run", F.concat(F.lit(f"{batch}/"), F.regexp_extract("folder", "=([^/]*)$", 1)))
        sizes = new.groupBy("run").agg(self._tier(F.sum("n_bytes")).alias("tier"))
        new = new.join(sizes, "run").select("run", "folder", "path", "tier", "n_rows", "n_bytes")
        for left in range(attempts - 1, -1, -1):
            before = self.manifest(version) if version else self.spark.createDataFrame([], ENTRY)
            try:
                return self._commit(before.unionByName(new), schema, version + 1)
            except Conflict:
                if not left:
                    raise
            version = self.versions()[-1]
            if [(f.name, f.dataType) for f in self.schema(version)] != [(f.name, f.dataType) for f in schema]:
                raise ValueError("columns differ from the table's")

    def compact(self, rounds: int | None = None, attempts: int = 3) -> int | None:
        """Merge every tier that has ``fan_in`` runs, until none has or for so many rounds; gives the last version, None if nothing was due.

        A merge reads whole runs and packs their pieces into target-sized files
        by coalescing partitions: rows stay where they are read. Each merge
        leaves fewer runs, so this ends. If another writer commits first, the
        merge counts for nothing and is tried anew on what there is then, up to
        ``attempts`` times a round, after which its Conflict is raised.
        """
        done = None
        for _ in itertools.count() if rounds is None else range(rounds):
            for left in range(attempts - 1, -1, -1):
                try:
                    merged = self._merge()
                    break
                except Conflict:
                    if not left:
                        raise
            if merged is None:
                return done
            done = merged
        return done

    def _merge(self) -> int | None:
        """One round of merges on one version, committed as the next; None if nothing is due."""
        known = self.versions()
        if not known:
            return None
        version = known[-1]
        entries, schema = self.manifest(version), self.schema(version)
        runs = entries.groupBy("run").agg(F.first("folder").alias("folder"), F.first("tier").alias("tier"), F.sum("n_bytes").alias("n_bytes"))
        # run by run, not row by row: tiers keep their number near fan_in times the logarithm of the size
        due = [r for r in runs.groupBy("tier").agg(F.collect_list("folder").alias("folders"), F.collect_list("run").alias("names"), F.sum("n_bytes").alias("n_bytes")).collect() if len(r.folders) >= self.fan_in]
        if not due:
            return None
        keep = entries.where(~F.col("run").isin([n for r in due for n in r.names]))
        for k, r in enumerate(due):
            batch = self._batch(version + 1, k)
            place = f"{self.folder}/data/{batch}"
            rows = self.spark.read.schema(schema).parquet(*sorted(r.folders))
            rows.coalesce(max(1, math.ceil(r.n_bytes / self.target_bytes))).write.option("compression", "zstd").parquet(place)
            new = self._files(place, schema)
            size = new.agg(F.sum("n_bytes").alias("size")).select(self._tier(F.col("size")).alias("tier"))  # one row
            keep = keep.unionByName(new.crossJoin(F.broadcast(size)).select(F.lit(batch).alias("run"), F.lit(place).alias("folder"), "path", "tier", "n_rows", "n_bytes"))
        return self._commit(keep, schema, version + 1)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete versions before the latest ``keep``, and folders that no version left names; gives the number of data folders deleted.

        What was changed less than ``grace`` seconds ago stays: a folder may
        belong to a writer that has not committed yet, and the name of a version
        must stay taken for writers that began before it.
        """
        known = self.versions()
        if not known:
            return 0
        plain = lambda folder: self._path(folder).toUri().getPath().rstrip("/")
        latest, gone = 1000 * (time.time() - grace), 0
        for v in known[:-keep]:
            name = self._path(f"{self.folder}/versions/{v:010d}.json")
            if self._fs.getFileStatus(name).getModificationTime() <= latest:
                self._fs.delete(name, False)
        left = self.versions()
        live = {plain(r.folder) for v in left for r in self.manifest(v).select("folder").distinct().collect()}
        live |= {plain(self._pointer(v)["entries"]) for v in left}
        inside = lambda at: [f for f in self._fs.listStatus(at) if f.isDirectory()]
        for top in ("data", "manifests"):
            for batch in inside(self._path(f"{self.folder}/{top}")):
                for f in inside(batch.getPath()) or [batch]:
                    if plain(f.getPath().toString()) not in live and f.getModificationTime() <= latest:
                        self._fs.delete(f.getPath(), True)
                        gone += top == "data"
        return gone

    def drop(self) -> None:
        """Delete the table."""
        self._fs.delete(self._path(self.folder), True)

    # reading

    def read(self, version: int | None = None, path: str | None = None) -> DataFrame:
        """Rows of a version; ``path`` names a further column with the file of each row."""
        schema = self.schema()
        if schema is None:
            raise ValueError("the table has no version")
        folders = [r.folder for r in self.manifest(version).select("folder").distinct().orderBy("folder").collect()]
        if not folders:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(path, F.lit("")) if path else empty
        rows = self.spark.read.schema(schema).parquet(*folders)
        return rows.withColumn(path, F.col("_metadata.file_path")) if path else rows


def sharded(docs: DataFrame, folder: str, arrival: F.Column, fan_in: int = 4, target_bytes: int = 256 << 20) -> DataFrame:
    """Append docs (doc_id, text, …) run by run, compact, and read the last version back.

    Gives (doc_id, n_bytes, text_sha256, tier, shard, shard_rows, arrival_rows,
    table_rows): the bytes and digest of the text as it was read back (a null text
    counts as empty), the tier of its shard, a number that comes from the shard's
    rows alone, how many rows the shard holds, and how many rows the manifests name
    for the run that the row arrived in and, after all merges, for the table.
    Repeated rows and null ids are kept; equal rows of one arrival may lie in any
    of its files. Very long texts are rows like any other. Other columns are
    stored and read back with the rest, but not given. An empty table gives no
    rows. The table stays in its folder; ``drop`` deletes it.
    """
    store = ShardTable(docs.sparkSession, folder, fan_in, target_bytes)
    key = fresh(docs, "arrival")
    first = store.append(docs.withColumn(key, arrival.cast("string")), F.col(key))
    runs = store.manifest(first).groupBy(F.regexp_extract("run", "/([^/]*)$", 1).alias("name")).agg(F.sum("n_rows").alias("arrival_rows"))
    named = {r.name: r.arrival_rows for r in runs.collect()}  # one for each arrival
    store.compact()
    store.vacuum(grace=0)  # nobody else writes here
    text = F.coalesce(F.col("text"), F.lit(""))
    file = fresh(docs, "file")
    rows = store.read(path=file).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), F.col(file).alias("path"), F.coalesce(F.col(key), F.lit(NO_ARRIVAL)).alias("name"))
    number = F.sum(F.shiftright(F.xxhash64("doc_id", "text_sha256"), 24)).alias("shard")
    held = store.manifest()
    files = rows.groupBy("path").agg(number).join(held.select("path", "tier", F.col("n_rows").alias("shard_rows")), "path")  # one row for each file
    total = held.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("table_rows"))
    arrivals = docs.sparkSession.createDataFrame(sorted(named.items()), "name string, arrival_rows long")
    return rows.join(files, "path").join(arrivals, "name").crossJoin(F.broadcast(total)).select("doc_id", "n_bytes", "text_sha256", "tier", "shard", "shard_rows", "arrival_rows", "table_rows")
