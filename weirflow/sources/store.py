"""Small files, state and journals on any file system that Spark writes to.

State is written as a new numbered version; a pointer of the same number, made last and never replaced, says that it counts.
What a send brought is put into a journal at once, so that a lost driver leaves no send unknown.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """A folder tree by Spark's own file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def local(self, path: str) -> str | None:
        """The path on this machine; None if it is on another file system."""
        fs, p = self._at(path)
        return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What lies in the folder; nothing where it isn't there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since the file was written."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def create(self, path: str, text: str, replace: bool = False) -> bool:
        """Write a file; False if it is there already and isn't to be replaced."""
        fs, p = self._at(path)
        try:
            if replace or not self._conditional(p):
                stream = fs.create(p, replace)
            else:
                stream = fs.createFile(p).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", "true").build()
        except Exception:
            if not replace and fs.exists(p):
                return False
            raise
        stream.write(bytearray(text.encode()))
        try:
            stream.close()
        except Exception:
            if not replace and fs.exists(p):  # a conditional put that came second
                return False
            raise
        return True

    def lines(self, path: str) -> Lines | LocalLines | None:
        """A new file that lines are added to; None where the file system can't show a line before the file is closed."""
        if (own := self.local(path)) is not None:
            Path(own).parent.mkdir(parents=True, exist_ok=True)
            return LocalLines(own)
        fs, p = self._at(path)
        if self._conditional(p):
            return None
        stream = fs.create(p, False)
        if stream.hasCapability("hflush"):
            return Lines(fs, p, stream)
        stream.close()
        return None

    @staticmethod
    def _conditional(p: Any) -> bool:
        """Object stores whose plain create looks first and puts later."""
        return p.toUri().getScheme() in ("s3a", "s3", "s3n")

    def assemble(self, path: str, head: str, parts: list[str], tail: str, cut: int = 0) -> None:
        """One file of the texts ``head`` and ``tail`` and, between them, files as they are, less the last ``cut`` bytes of the
        last. Bytes go from stream to stream within the JVM; the file is there whole or not at all."""
        fs, p = self._at(path)
        _, part = self._at(f"{path}.tmp")
        out = fs.create(part, True)
        try:
            out.write(bytearray(head.encode()))
            sized = [(fs.getFileStatus(x).getLen(), x) for x in (self._at(x)[1] for x in parts)]
            sized = [(n, x) for n, x in sized if n]
            for i, (n, x) in enumerate(sized):
                stream = fs.open(x)
                try:
                    self.spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, n - (cut if i == len(sized) - 1 else 0))
                finally:
                    stream.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(part, p):
            raise OSError(f"{path} can't be put in place")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def delete_on_exit(self, path: str) -> None:
        fs, p = self._at(path)
        fs.deleteOnExit(p)


class Lines:
    """A file that grows by lines, each of which is there for readers, whatever becomes of the driver, when ``add`` is done."""

    def __init__(self, fs: Any, path: Any, stream: Any) -> None:
        self.fs, self.path, self.stream, self.size, self.shown = fs, path, stream, 0, False

    def add(self, text: str) -> bool:
        """False where the line is there only by closing the file: the file system lists its length no earlier, as HDFS does."""
        raw = bytearray(text.encode())
        self.stream.write(raw)
        self.stream.hflush()
        self.size += len(raw)
        if not self.shown:
            self.shown = self.fs.getFileStatus(self.path).getLen() == self.size
            if not self.shown:
                self.close()
        return self.shown

    def close(self) -> None:
        self.stream.close()


class LocalLines:
    """The same on this machine's disk, without the JVM."""

    def __init__(self, path: str) -> None:
        self.file = open(path, "xb", buffering=0)  # noqa: SIM115 - closed by close

    def add(self, text: str) -> bool:
        left = memoryview(text.encode())
        while left:
            left = left[self.file.write(left) :]
        return True

    def close(self) -> None:
        self.file.close()


class Busy(RuntimeError):
    """Another run is under way."""


class Fenced(RuntimeError):
    """Another run has taken over; this one may do nothing more that counts."""


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which goes with the session: what is read twice is the same both times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weirflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    Files(spark).delete_on_exit(path)
    return spark.read.schema(df.schema).parquet(path)


class Moved(RuntimeError):
    """Another run has moved the state on since it was read."""


class Lost(RuntimeError):
    """A state that has versions but no pointer: it must not pass for an empty one."""


class Versioned:
    """A table of numbered versions.

    ``pointers/n`` names the folder of version n and holds its notes; it is written after the folder is whole, in one go, and
    is never changed, so at every moment the highest pointer that reads as JSON is the state. Pointer 0, without a folder,
    is made before the first version. A version rests on the one that was read; if another has come since, ``Moved`` is raised.
    With a ``lease`` (``lease.Lease``) the pointer holds its number, and a run that another has taken over from makes none.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keep: int = 3, lease: Any = None) -> None:
        self.spark, self.root, self.schema, self.keep, self.files, self.lease = spark, root.rstrip("/"), schema, keep, Files(spark), lease
        self.base: int | None = None  # the version that was read last, on which the next one rests

    def _pointer(self, n: int) -> dict[str, Any] | None:
        with contextlib.suppress(ValueError, TypeError):
            found = json.loads(self.files.read(f"{self.root}/pointers/{n}") or "")
            return found if isinstance(found, dict) and "folder" in found else None
        return None

    def _numbers(self) -> list[int]:
        return sorted((int(x) for x in self.files.names(f"{self.root}/pointers") if x.isdigit()), reverse=True)

    def current(self) -> dict[str, Any]:
        """The pointer that counts: number, folder (None for no rows yet), notes."""
        for n in self._numbers():
            if found := self._pointer(n):
                return found
        if any(x.startswith("v-") for x in self.files.names(self.root)):
            raise Lost(f"{self.root}: versions without a pointer")
        return {"number": 0, "folder": None, "notes": {}}

    def notes(self) -> dict[str, Any]:
        return self.current()["notes"]

    def read(self) -> DataFrame:
        now = self.current()
        self.base = now["number"]
        folders = sorted(now["folders"].values()) if "folders" in now else [now["folder"]] if now["folder"] else []
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def write(self, rows: DataFrame, notes: dict[str, Any] | None = None) -> str:
        """A new version, its notes added to those before; older versions than the last ``keep`` go.

        Rows are written as the plan that made them spread them, whatever accounts they belong to.
        """
        now = self.current()
        if self.base not in (None, now["number"]):
            raise Moved(f"{self.root}: another run has written version {now['number']}")
        if now["folder"] is None:
            self.files.create(f"{self.root}/pointers/0", json.dumps({"number": 0, "folder": None, "notes": {}}))
        number = max([*self._numbers(), 0]) + 1
        folder = f"v-{number:010d}-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.root}/{folder}")
        told = json.dumps({"number": number, "folder": folder, "notes": now["notes"] | (notes or {})} | self._fence(now))
        if self.current()["number"] != now["number"] or not self.files.create(f"{self.root}/pointers/{number}", told):
            self.files.delete(f"{self.root}/{folder}")
            raise Moved(f"{self.root}: another run has written version {number}")
        self.base = number
        self._tidy(number)
        return folder

    def _fence(self, now: dict[str, Any]) -> dict[str, int]:
        """What a pointer says of the lease; ``Fenced`` where the lease has gone, or a later one has written already."""
        if self.lease is None:
            return {"fence": now["fence"]} if "fence" in now else {}
        self.lease.check()
        if now.get("fence", 0) > self.lease.number:
            raise Fenced(f"{self.root}: written under a later lease")
        return {"fence": self.lease.number}

    def _tidy(self, number: int) -> None:
        held = {p["folder"] for n in self._numbers()[: self.keep] if (p := self._pointer(n))}
        for name in self.files.names(self.root):
            if name.startswith("v-") and name not in held and int(name.split("-")[1]) < number:
                self.files.delete(f"{self.root}/{name}")
        for n in self._numbers()[self.keep :]:
            self.files.delete(f"{self.root}/pointers/{n}")


class Journal:
    """What each send of a run brought, a line of an open file at once, and, before that, what is about to be sent. Where a
    file's lines can't be read before it is closed (object stores, HDFS), each is a small file, gathered into larger ones now
    and then.

    Sends are made in the order of their intents, one at a time, and each outcome is noted before the next send. So of a run
    that was cut off at most one send is in doubt: the first intended one without an outcome. A journal that is there when a
    run starts is of a run that didn't come to its end: ``leftovers`` finds it.
    """

    GATHER = 200
    #: Rows whose intents lie in one file.
    FILE = 10_000

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, name: str | None = None, lease: Any = None) -> None:
        self.spark, self.root, self.schema, self.files, self.lease = spark, root.rstrip("/"), schema, Files(spark), lease
        self.n, self.intended, self.held = 0, 0, []
        self.log: Lines | LocalLines | None = None  # outcomes
        self.plan: Lines | LocalLines | None = None  # intents, from ``planned`` on
        self.planned, self.grows = 0, True
        self._named(name or f"j-{uuid.uuid4().hex}")

    def _named(self, name: str) -> None:
        self._close()
        self.name, self.path, self.intents = name, f"{self.root}/{name}", f"{self.root}/i-{name}"

    def _close(self) -> None:
        for x in (self.log, self.plan):
            if x is not None:
                x.close()
        self.log = self.plan = None

    def intend(self, rows: list[dict[str, Any]]) -> None:
        """Note what is about to be sent, up to ``GATHER`` rows or so at once: their keys, in order."""
        text = "".join(json.dumps({"n": self.intended + i} | r, ensure_ascii=False) + "\n" for i, r in enumerate(rows))
        if self.plan is not None and self.intended - self.planned >= self.FILE:
            self.plan.close()
            self.plan = None
        path = f"{self.intents}/{self.intended:012d}.json"
        if self.grows and self.plan is None:
            self.plan, self.planned = self.files.lines(path), self.intended
            self.grows = self.plan is not None
        if self.plan is None:
            self.files.create(path, text, replace=True)
        elif not self.plan.add(text):
            self.plan, self.grows = None, False
        self.intended += len(rows)

    def check(self) -> None:
        """Raise ``Fenced`` if another run has taken over: asked before each send."""
        if self.lease is not None:
            self.lease.check()

    def add(self, outcome: dict[str, Any]) -> None:
        """The outcome of the next send. One that comes after another run has taken over goes into a journal of its own, as
        this one was read already."""
        if self.lease is not None and not self.lease.held():
            self.held = []
            self._named(f"j-{uuid.uuid4().hex}")
        line = json.dumps(outcome | {"n": self.n}, ensure_ascii=False)
        if self.grows and self.log is None:
            self.log = self.files.lines(f"{self.path}/log-{self.n:012d}.json")
            self.grows = self.log is not None
        if self.log is not None:
            if not self.log.add(line + "\n"):
                self.log, self.grows = None, False
            self.n += 1
            return
        self.files.create(f"{self.path}/one-{self.n:012d}.json", line + "\n", replace=True)
        self.held.append((self.n, line))
        self.n += 1
        if len(self.held) >= self.GATHER:
            self._gather()

    def _gather(self) -> None:
        """Until the single files are gone their lines are there twice; ``read`` counts them once."""
        self.files.create(f"{self.path}/many-{self.held[0][0]:012d}.json", "".join(f"{line}\n" for _, line in self.held), replace=True)
        for n, _ in self.held:
            self.files.delete(f"{self.path}/one-{n:012d}.json")
        self.held = []

    def _outcomes(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("n", T.LongType())])
        if not any(x.endswith(".json") for x in self.files.names(self.path)):
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The outcomes, each once; a line cut short by a crash is left out."""
        return self._outcomes().drop("n").distinct()

    def in_doubt(self) -> dict[str, Any] | None:
        """The send that may or may not have been made: the first intended one without an outcome."""
        done = self._outcomes().agg(F.max("n")).first()[0]
        done = -1 if done is None else done
        # A file's name says which row it begins with.
        names = self.files.names(self.intents)
        for name in [x for x, after in zip(names, [*names, None][1:], strict=True) if after is None or int(after.split(".")[0]) > done + 1]:
            for line in (self.files.read(f"{self.intents}/{name}") or "").splitlines():
                try:
                    row = json.loads(line)
                except ValueError:  # cut short while it was written: no send followed
                    return None
                if row.pop("n") == done + 1:
                    return row
        return None

    def drop(self) -> None:
        self._close()
        self.files.delete(self.path)
        self.files.delete(self.intents)

    @classmethod
    def leftovers(cls, spark: SparkSession, root: str, schema: T.StructType) -> list[Journal]:
        names = {x.removeprefix("i-") for x in Files(spark).names(root) if x.startswith(("j-", "i-j-"))}
        return [cls(spark, root, schema, x) for x in sorted(names)]


class Checkpoints:
    """How far an account's fetch came: where to go on, and the rows and warnings that are there already.

    The rows are a table beside the description, which is written last; both go when the run has come to its end.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, provider: str, account: str) -> str:
        name = provider + (f"_{account}" if account and account != "default" else "")
        return f"{self.root}/{name}.json"

    def load(self, provider: str, account: str) -> dict[str, Any] | None:
        """next_index, rows (a folder or None), warnings; None where there is none that can be read."""
        try:
            found = json.loads(self.files.read(self.path(provider, account)) or "")
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def rows_path(self) -> str:
        """A fresh folder for an account's rows."""
        return f"{self.root}/rows-{uuid.uuid4().hex}"

    def save(self, provider: str, account: str, next_index: int, rows: list[str], warnings: list[str]) -> str:
        path = self.path(provider, account)
        text = json.dumps({"provider": provider, "account": account, "next_index": next_index, "rows": rows, "warnings": warnings}, ensure_ascii=False)
        self.files.create(path, text, replace=True)
        return path

    def clear(self, provider: str, account: str) -> None:
        """No error where there is none."""
        found = self.load(provider, account)
        self.files.delete(self.path(provider, account))
        for folder in (found or {}).get("rows") or []:
            self.files.delete(folder)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import atexit
    import shutil
    import tempfile

    own = tempfile.mkdtemp(prefix="weirflow-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"
