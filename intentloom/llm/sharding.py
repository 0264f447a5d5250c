"""Sharding by size-tiered compaction over versioned manifests.

A store is a folder of immutable Parquet shards. What belongs to it is what its newest manifest lists:

* ``append`` writes an arrival as shards, one for each input partition, and commits a manifest that has
  them besides the old ones.
* ``compact`` sorts shards into tiers by size (a tier's sizes differ by a factor of ``FAN_IN`` at most). A tier with
  a run of ``FAN_IN`` or more is merged into files of about ``TARGET`` bytes, and so on upwards, so a row is
  rewritten about log(TARGET / least shard) / log(FAN_IN) times in its life. Nothing is shuffled:
  each merge task reads whole shards that together fill a target. Shards of ``TARGET`` / 2 or more are left alone.
* A commit writes the next manifest under a temporary name and gives it its number by a rename (on a local disk by a hard link, as a rename
  there would replace what another writer has put meanwhile), which fails if
  another writer was first; that writer's changes are then taken in and the commit is tried
  again. Readers see the old version or the new one. A merge whose row count differs from its
  inputs' is not committed. ``vacuum`` deletes shards that the newest manifest doesn't list.

The rename must be atomic, as in HDFS.

Defined results: every row, null or not, repeated or not, of any length, with whatever columns, is read back
exactly as often as it was appended; arrivals of another schema are refused; an empty arrival adds no
shard, an empty store has its schema and no rows; a store without a version can't be read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch

TARGET = 128 << 20
FAN_IN = 4
#: shards below this size are all in the lowest tier
LEAST = 1 << 20
ATTEMPTS = 20
#: bytes of input in a shard that arrives, and shards that arrive together
SMALL, ARRIVAL = 8 << 20, 24


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    size: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fan_in: int = FAN_IN):
        if fan_in < 2 or target < 1:
            raise ValueError("fan_in must be 2 or more and target positive")
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._at(folder))]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The given version, or the newest; None if there is none."""
        versions = [int(n.split(".")[0]) for n, _ in self._names(f"{self.path}/manifests") if n.endswith(".json") and n[0].isdigit()]
        if version is None:
            version = max(versions, default=None)
        if version not in versions:
            return None
        stream = self._fs.open(self._at(f"{self.path}/manifests/{version:012d}.json"))
        try:
            data = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(data["version"], data["schema"], tuple(Shard(**s) for s in data["shards"]))

    def _publish(self, manifest: Manifest) -> bool:
        """Whether this writer was the first to commit that version."""
        folder = f"{self.path}/manifests"
        self._fs.mkdirs(self._at(folder))
        draft, final = self._at(f"{folder}/draft-{uuid.uuid4().hex}"), self._at(f"{folder}/{manifest.version:012d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": [asdict(s) for s in manifest.shards]}).encode()))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            if self._fs.getScheme() == "file":
                path = self._jvm.java.nio.file.Path.of
                none = self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
                self._jvm.java.nio.file.Files.createLink(*(path(x.toUri().getPath(), none) for x in (final, draft)))
                self._fs.delete(draft, False)
            else:
                hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, options)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def _commit(self, schema: str, added: list[Shard], removed: set[str] = frozenset()) -> Manifest:
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if now and now.schema != schema:
                raise ValueError(f"the store has schema {now.schema}, not {schema}")
            have = now.shards if now else ()
            if not removed <= {s.path for s in have}:
                raise RuntimeError("another writer has merged these shards meanwhile")
            new = Manifest(now.version + 1 if now else 1, schema, (*(s for s in have if s.path not in removed), *added))
            if self._publish(new):
                return new
        raise RuntimeError(f"no commit in {ATTEMPTS} attempts")

    def _write(self, df: DataFrame) -> list[Shard]:
        """The files that ``df`` becomes, but for empty ones; counted from their footers."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        sizes = {n: size for n, size in self._names(f"{self.path}/{folder}") if n.endswith(".parquet")}
        if not sizes:
            return []
        counted = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").groupBy(F.input_file_name().alias("f")).count().collect()
        rows = {r["f"].rsplit("/", 1)[1]: r["count"] for r in counted}
        return [Shard(f"{folder}/{n}", rows[n], size) for n, size in sorted(sizes.items()) if rows.get(n)]

    def append(self, arrival: DataFrame) -> Manifest:
        return self._commit(arrival.schema.json(), self._write(arrival))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / LEAST, self.fan_in)) + 1)

    def _merge_session(self) -> SparkSession:
        """A session whose scans put whole shards together until a target is full."""
        session = self.spark.newSession()
        for key, value in {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}.items():
            session.conf.set(f"spark.sql.files.{key}", str(value))
        return session

    def compact(self, keep_merged: bool = True) -> Manifest | None:
        """Merge until no tier has ``fan_in`` shards that fewer could hold; commits a version for each tier merged. Without ``keep_merged`` what has been
        merged is deleted at once, so older versions can't be read."""
        session, done = self._merge_session(), set()
        while now := self.manifest():
            tiers: dict[int, list[Shard]] = defaultdict(list)
            for s in now.shards:
                if 2 * s.size < self.target:
                    tiers[self.tier(s.size)].append(s)
            run = next((x for t, x in sorted(tiers.items()) if len(x) >= self.fan_in and frozenset(s.path for s in x) not in done), None)
            if run is None:
                return now
            merged = self._write(session.read.schema(StructType.fromJson(json.loads(now.schema))).parquet(*(f"{self.path}/{s.path}" for s in run)))
            if sum(s.rows for s in merged) != sum(s.rows for s in run):
                raise RuntimeError("a merge has changed the number of rows")
            if len(merged) < len(run):
                self._commit(now.schema, merged, {s.path for s in run})
                for s in () if keep_merged else run:
                    self._fs.delete(self._at(f"{self.path}/{s.path}"), False)
            else:  # these can't become fewer; on to the next tier
                done.add(frozenset(s.path for s in run))
                for folder in {s.path.rsplit("/", 1)[0] for s in merged}:
                    self._fs.delete(self._at(f"{self.path}/{folder}"), True)
        return None

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if now is None:
            raise ValueError(f"{self.path} has no such version")
        schema = StructType.fromJson(json.loads(now.schema))
        if not now.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in now.shards))

    def vacuum(self) -> int:
        """Delete the shards that the newest version doesn't list, and older manifests; to be called while nobody reads or writes. How many files went."""
        now, gone = self.manifest(), 0
        live = {s.path for s in now.shards} if now else set()
        for folder, _ in self._names(f"{self.path}/shards"):
            names = [n for n, _ in self._names(f"{self.path}/shards/{folder}")]
            dead = [n for n in names if n.endswith(".parquet") and f"shards/{folder}/{n}" not in live]
            for n in names if len(dead) == sum(n.endswith(".parquet") for n in names) else dead:
                gone += self._fs.delete(self._at(f"{self.path}/shards/{folder}/{n}"), False)
        for n, _ in self._names(f"{self.path}/manifests"):
            if now and n.endswith(".json") and n[0].isdigit() and int(n.split(".")[0]) < now.version:
                gone += self._fs.delete(self._at(f"{self.path}/manifests/{n}"), False)
        return gone


def shard(documents: DataFrame, target: int = TARGET, small: int = SMALL, arrival: int = ARRIVAL) -> DataFrame:
    """``documents`` as they would arrive: small shards, of which ``arrival`` at a time are committed to a new store in the shared folder; after
    each arrival the store is compacted and what was merged deleted. Its newest version, read."""
    spark = documents.sparkSession
    store = Store(spark, scratch.new_path(spark, "store"), target)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(small))
        shards = store._write(documents)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    schema = documents.schema.json()
    for i in range(0, max(1, len(shards)), arrival):
        store._commit(schema, shards[i : i + arrival])
        store.compact(keep_merged=False)
    store.vacuum()
    return store.read()


SQL = "SELECT * FROM documents"
