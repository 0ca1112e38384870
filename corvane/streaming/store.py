"""State under a stream of changes: a bucketed base, deltas read over it, compaction, and builds that a later one supersedes.

    delta/<n>/       the last change of each key of proposal n: all that a batch writes
    built/<n>        proposals up to n are part of the state
    base/<n>/bucket= buckets of rows, written by the compaction at build n
    manifest/<n>     which base holds each bucket, from build n on
    owner/<term>     claims of writers; the highest one may write

A proposal that another one has followed is not built: the later build takes its changes along, as a rebuild does that
finds a newer one waiting. A folder counts once its commit mark is there, a manifest once it has been renamed into place, so a driver that
dies leaves the state that was, and goes on from it when it starts again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.streaming.incremental import latest_changes

BUILD = "__build"


class DeltaStore:
    """foreachBatch sink and its state. schema: the columns of a row, key included; batches have order and type (add, change, delete) besides."""

    def __init__(self, spark: SparkSession, folder: str, key: str, order: str, schema: str, buckets: int = 64, compact_after: int = 16) -> None:
        self.spark, self.folder, self.key, self.order, self.schema = spark, folder.rstrip("/"), key, order, schema
        self.buckets, self.compact_after, self._term = buckets, compact_after, None

    # ---- files ----
    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str, whole: bool = True) -> list[int]:
        """Numbers under a folder, in order; those with a commit mark, where `whole`."""
        fs, p = self._path(kind, "*/_SUCCESS" if whole else "*")
        found = [x.getPath() for x in fs.globStatus(p) or []]
        names = [(x.getParent() if whole else x).getName() for x in found]
        return sorted(int(n) for n in names if n.isdigit())

    def _dir(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}/{n:020d}"

    def _delete(self, kind: str, n: int) -> None:
        fs, p = self._path(kind, f"{n:020d}")
        fs.delete(p, True)

    def _create(self, kind: str, n: int) -> bool:
        """Makes an empty file; false if it is there."""
        fs, p = self._path(kind, f"{n:020d}")
        fs.mkdirs(p.getParent())
        return bool(fs.createNewFile(p))

    def _manifest(self, back: int = 0) -> tuple[int, dict[int, int]]:
        """Number of the last manifest, or of one before it, and the base of each bucket."""
        known = self._numbers("manifest", whole=False)
        if len(known) <= back:
            return -1, {}
        text = self.spark.read.text(self._dir("manifest", known[-1 - back]), wholetext=True).first()[0]
        return known[-1 - back], {int(b): n for b, n in json.loads(text).items()}

    def _write_manifest(self, n: int, bases: dict[int, int]) -> None:
        fs, tmp = self._path(f"manifest-{n:020d}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(bases).encode()))
        out.close()
        _, p = self._path("manifest", f"{n:020d}")
        fs.mkdirs(p.getParent())
        fs.rename(tmp, p)

    def _own(self) -> None:
        """Claims the folder before the first write; fails where another writer has claimed it since."""
        if self._term is None:
            self._term = max(self._numbers("owner", whole=False), default=-1) + 1
            while not self._create("owner", self._term):
                self._term += 1
        if self._numbers("owner", whole=False)[-1] != self._term:
            raise RuntimeError(f"{self.folder}: another writer has taken over")

    # ---- rows ----
    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _columns(self) -> list[str]:
        return self._none().columns

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _base(self, bases: dict[int, int]) -> DataFrame:
        paths = [f"{self._dir('base', n)}/bucket={b}" for b, n in sorted(bases.items())]
        return self.spark.read.schema(self._none().schema).parquet(*paths) if paths else self._none()

    def _changes(self, numbers: list[int]) -> DataFrame | None:
        """The last change of each key over some proposals; that of the later proposal holds."""
        if not numbers:
            return None
        all_ = self.spark.read.parquet(*[self._dir("delta", n) for n in numbers])
        w = Window.partitionBy(self.key).orderBy(F.desc(BUILD))
        return all_.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", BUILD)

    def _over(self, base: DataFrame, changes: DataFrame | None) -> DataFrame:
        if changes is None:
            return base
        rest = base.join(changes.select(self.key), self.key, "left_anti")
        return rest.select(*self._columns()).unionByName(changes.filter("type <> 'delete'").select(*self._columns()))

    def _since(self, n: int) -> list[int]:
        """Whole proposals after n that are built."""
        last = max(self._numbers("built", whole=False), default=-1)
        return [m for m in self._numbers("delta") if n < m <= last]

    def state(self) -> DataFrame:
        """Rows as of the last build: the base, and over it the deltas since."""
        n, bases = self._manifest()
        return self._over(self._base(bases), self._changes(self._since(n)))

    # ---- writes ----
    def propose(self, changes: DataFrame, n: int) -> bool:
        """Writes the changes of proposal n; false if they have been written before."""
        if n in self._numbers("delta") or n <= max(self._numbers("built", whole=False), default=-1):
            return False
        self._own()
        latest_changes(changes, self.key, self.order).withColumn(BUILD, F.lit(n).cast("long")).write.mode("overwrite").parquet(self._dir("delta", n))
        return True

    def build(self, n: int) -> DataFrame | None:
        """Makes the proposals up to n part of the state and returns their changes, one a key; None where a later proposal supersedes n, or n is built."""
        built = max(self._numbers("built", whole=False), default=-1)
        known = self._numbers("delta")
        if n <= built or n not in known or known[-1] > n:
            return None
        self._own()
        self._create("built", n)
        done = self._changes([m for m in known if built < m <= n])
        if len(self._since(self._manifest()[0])) >= self.compact_after:
            self.compact()
        return done

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.propose(batch, epoch)
        self.build(epoch)

    def compact(self) -> None:
        """Writes the buckets that deltas touch anew, and forgets what neither this manifest nor the one before it needs."""
        n, bases = self._manifest()
        numbers = self._since(n)
        changes = self._changes(numbers)
        if changes is None:
            return
        self._own()
        touched = [r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        rows = self._over(self._base({b: bases[b] for b in touched if b in bases}), changes).withColumn("bucket", self._bucket())
        new = numbers[-1]
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._dir("base", new))
        filled = {int(r["bucket"]) for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(self._dir("base", new)).select("bucket").distinct().collect()}
        self._write_manifest(new, {b: m for b, m in bases.items() if b not in touched} | dict.fromkeys(sorted(filled), new))
        before, kept = self._manifest(1)  # readers may still be on the state before
        needed = set(kept.values()) | set(self._manifest()[1].values())
        for kind, gone in (("delta", [m for m in self._numbers("delta") if m <= before]), ("base", [m for m in self._numbers("base") if m not in needed]), ("manifest", [m for m in self._numbers("manifest", whole=False) if m < before])):
            for m in gone:
                self._delete(kind, m)
        for m in self._numbers("built", whole=False)[:-1]:
            self._delete("built", m)
