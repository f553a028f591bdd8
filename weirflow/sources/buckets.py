"""State in hash buckets of (account, fingerprint): a run reads, merges and rewrites the buckets that its rows touch.

A version is a manifest, which names for every bucket the folder that holds it; a write makes folders for the buckets that it
replaces and takes the others over from the version before, so what it costs goes by what changed. Manifests are the numbered
pointers of ``Versioned``, with all that it promises.

Buckets are Spark's own: each is cut by the hash that shuffles use, and read back as a bucketed table, so rows that are
repartitioned by the same columns into as many parts (``aligned``) meet the state where it lies. State rows are not shuffled, neither to
classify a run's rows nor to merge them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.sources.store import Moved, Versioned

#: What the rows of a bucket have in common; the last is the key without its number.
BY = ["provider", "provider_account_id", "fingerprint"]
#: Most buckets that are read or written by name in one statement.
NAMED = 1000


def with_fingerprint(rows: DataFrame) -> DataFrame:
    return rows if "fingerprint" in rows.columns else rows.withColumn("fingerprint", F.substring_index("dedup_key", "|#", 1))


class Bucketed(Versioned):
    """A versioned table in buckets. ``buckets`` counts for a state that has none yet, the session's number of shuffle partitions where it isn't given; ``rebucket``
    changes it, as state grows: a bucket is the work of one task.

    A state that was written in one piece is read as it is, and put into buckets by the next write.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, buckets: int | None = None, keep: int = 3, lease: Any = None) -> None:
        super().__init__(spark, root, schema, keep, lease)
        self._wanted, self._tables = buckets, []

    def _wants(self) -> int:
        return self._wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def buckets(self) -> int:
        """How many buckets the state has, or will have."""
        return self.current().get("buckets") or self._wants()

    def _number(self, n: int) -> Column:
        return F.pmod(F.hash(*BY), F.lit(n))

    def aligned(self, rows: DataFrame) -> DataFrame:
        """``rows`` laid out as the buckets are: one shuffle, after which they meet the state without another."""
        return with_fingerprint(rows).repartition(self.buckets, *BY)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` belong to: at most one number a bucket comes to the driver."""
        return sorted(r[0] for r in with_fingerprint(rows).select(self._number(self.buckets)).distinct().collect())

    def _table(self, kind: str) -> str:
        name = f"weirflow_{kind}_{uuid.uuid4().hex}"
        self._tables.append(name)
        return name

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The state, or some buckets of it, with its fingerprints."""
        now = self.current()
        self.base = now["number"]
        if now["folder"] is not None and "folders" not in now:
            return with_fingerprint(self.spark.read.schema(self.schema).parquet(f"{self.root}/{now['folder']}"))
        n, folders = now.get("buckets") or self._wants(), now.get("folders") or {}
        held = sorted(int(b) for b in folders if only is None or int(b) in set(only))
        name = self._table("state")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*self.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("bucket", T.IntegerType())])
        self.spark.sql(f"create table {name} ({columns}) using parquet partitioned by (bucket) clustered by ({', '.join(BY)}) into {n} buckets location '{self.root}/none'")
        for a in range(0, len(held), NAMED):
            self.spark.sql(f"alter table {name} add " + " ".join(f"partition (bucket = {b}) location '{self.root}/{folders[str(b)]}'" for b in held[a : a + NAMED]))
        return self.spark.table(name).drop("bucket")

    def write(self, rows: DataFrame, notes: dict[str, Any] | None = None) -> str:
        """A new version that holds ``rows`` alone."""
        return self._write(rows, None, notes)

    def replace(self, rows: DataFrame, touched: list[int], notes: dict[str, Any] | None = None) -> str:
        """A new version in which ``rows`` are all there is in the buckets ``touched``; the others stay as they are."""
        return self._write(rows, touched, notes)

    def merge(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], notes: dict[str, Any] | None = None) -> list[int]:
        """Merge ``rows`` into the buckets that they touch: ``merged`` gets what is there and the aligned rows, and gives what is
        to be there. Without rows nothing is written (of ``notes``, a manifest alone). Returns the buckets touched."""
        now = self.current()
        if now["folder"] is not None and "folders" not in now:  # in one piece so far
            self._write(merged(self.read(), with_fingerprint(rows)), None, notes)
            return list(range(self.buckets))
        if self.base not in (None, now["number"]):
            raise Moved(f"{self.root}: another run has written version {now['number']}")
        touched = self.touched(rows)
        if touched:
            self._write(merged(self.read(touched), self.aligned(rows)), touched, notes)
        elif notes:
            self._point(now, now.get("folders") or {}, now.get("buckets") or self._wants(), now["folder"], notes)
        return touched

    def rebucket(self, buckets: int) -> None:
        """The same rows in another number of buckets."""
        rows, self._wanted = self.read(), buckets
        self._write(rows, None, None, buckets)

    def _write(self, rows: DataFrame, touched: list[int] | None, notes: dict[str, Any] | None, buckets: int | None = None) -> str:
        now = self.current()
        if self.base not in (None, now["number"]):
            raise Moved(f"{self.root}: another run has written version {now['number']}")
        n = buckets or now.get("buckets") or self._wants()
        number = max([*self._numbers(), 0]) + 1
        folder, name = f"v-{number:010d}-{uuid.uuid4().hex}", self._table("stage")
        typed = with_fingerprint(rows).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], "fingerprint")
        typed.withColumn("bucket", self._number(n)).write.partitionBy("bucket").bucketBy(n, *BY).sortBy(*BY).format("parquet").option("path", f"{self.root}/{folder}").saveAsTable(name)
        self._drop(name)
        made = {x.removeprefix("bucket="): f"{folder}/{x}" for x in self.files.names(f"{self.root}/{folder}") if x.startswith("bucket=")}
        held = {} if touched is None else {b: f for b, f in (now.get("folders") or {}).items() if int(b) not in set(touched)}
        if strays := [b for b in made if b in held]:
            self.files.delete(f"{self.root}/{folder}")
            raise ValueError(f"rows of buckets that aren't replaced: {strays[:5]}")
        return self._point(now, held | made, n, folder, notes, number)

    def _point(self, now: dict[str, Any], folders: dict[str, str], n: int, folder: str | None, notes: dict[str, Any] | None, number: int | None = None) -> str:
        if now["folder"] is None and now["number"] == 0:
            self.files.create(f"{self.root}/pointers/0", json.dumps({"number": 0, "folder": None, "notes": {}}))
        number = number or max([*self._numbers(), 0]) + 1
        told = json.dumps({"number": number, "folder": folder, "buckets": n, "folders": folders, "notes": now["notes"] | (notes or {})} | self._fence(now))
        if self.current()["number"] != now["number"] or not self.files.create(f"{self.root}/pointers/{number}", told):
            if folder and folder != now["folder"]:
                self.files.delete(f"{self.root}/{folder}")
            raise Moved(f"{self.root}: another run has written version {number}")
        self.base = number
        self._tidy(number)
        return folder or ""

    def _tidy(self, number: int) -> None:
        """Buckets that none of the last ``keep`` manifests names go, and folders that hold none any more."""
        kept = [p for n in self._numbers()[: self.keep] if (p := self._pointer(n))]
        whole = {p["folder"] for p in kept if "folders" not in p}
        held = {f for p in kept for f in (p.get("folders") or {}).values()}
        tops = {f.split("/")[0] for f in held}
        for name in self.files.names(self.root):
            if not name.startswith("v-") or name in whole or int(name.split("-")[1]) >= number:
                continue
            if name not in tops:
                self.files.delete(f"{self.root}/{name}")
                continue
            for x in self.files.names(f"{self.root}/{name}"):
                if x.startswith("bucket=") and f"{name}/{x}" not in held:
                    self.files.delete(f"{self.root}/{name}/{x}")
        for n in self._numbers()[self.keep :]:
            self.files.delete(f"{self.root}/pointers/{n}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self._tables.remove(name)

    def close(self) -> None:
        """Forget the tables that ``read`` registered; what was read through them can't be computed any more. The state stays."""
        for name in list(self._tables):
            self._drop(name)
