"""One run at a time: a renewed lease with a number that only grows.

Whoever takes the lease makes the next numbered file, never an older one again; the highest number holds it. A run that was
taken for lost, because its lease wasn't renewed in time, finds a higher number than its own when it comes back: it is fenced
off, and neither its state, nor its journal, nor its next send counts or is made. Numbers go into the state's pointers, too.

Files are made only where there is none (on S3A by a conditional put); the file system must do that at once for all drivers, as HDFS, ABFS, GCS and S3A with
conditional writes do. Where it doesn't, of two drivers that make the same number the one whose name the file doesn't hold is
fenced off at its first check.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from weirflow.sources.store import Busy, Fenced, Files

#: Seconds after which a lease that wasn't renewed is of a driver that was lost; it is renewed three times as often.
LEASE = 600.0


class Lease:
    """The right to be the one run on ``root``. ``number`` is its fencing number."""

    def __init__(self, spark: SparkSession, root: str, seconds: float = LEASE) -> None:
        self.files, self.folder, self.seconds = Files(spark), f"{root.rstrip('/')}/lease", seconds
        self.owner = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}"
        self.number = 0
        self._here: str | None = None  # the folder, on this machine's disk
        self._stop, self._thread = threading.Event(), None

    def _numbers(self) -> list[int]:
        return sorted(int(x) for x in self.files.names(self.folder) if x.isdigit())

    def _live(self, number: int) -> bool:
        """Whether the lease of that number was renewed lately and not given back."""
        if self.files.exists(f"{self.folder}/{number}.done"):
            return False
        beats = [self.files.age(p) for p in (f"{self.folder}/{number}", f"{self.folder}/{number}.beat") if self.files.exists(p)]
        return min(beats, default=float("inf")) < self.seconds

    def take(self) -> Lease:
        last = max(self._numbers(), default=0)
        if last and self._live(last):
            raise Busy(f"a run is already under way: {self.folder}")
        if not self.files.create(f"{self.folder}/{last + 1}", json.dumps({"owner": self.owner, "since": time.time()})):
            raise Busy(f"a run is already under way: {self.folder}")
        self.number = last + 1
        self._here = self.files.local(self.folder)
        self.check()
        for n in self._numbers():
            if n < last:
                for name in (f"{n}", f"{n}.beat", f"{n}.done"):
                    self.files.delete(f"{self.folder}/{name}")
        self._thread = threading.Thread(target=self._renew, daemon=True)
        self._thread.start()
        return self

    def held(self) -> bool:
        """Whether no other run has taken over. On this machine's disk it is asked without the JVM, as each send asks twice."""
        numbers = self._numbers() if self._here is None else [int(x) for x in os.listdir(self._here) if x.isdigit()]
        if max(numbers, default=0) != self.number:
            return False
        with contextlib.suppress(ValueError, FileNotFoundError):
            own = self.files.read(f"{self.folder}/{self.number}") if self._here is None else Path(f"{self._here}/{self.number}").read_text()
            return json.loads(own or "{}").get("owner") == self.owner
        return False

    def check(self) -> None:
        """Raise ``Fenced`` if another run has taken over. Asked before everything that can't be taken back."""
        if not self.held():
            raise Fenced(f"another run has taken over: {self.folder}")

    def renew(self) -> None:
        self.files.create(f"{self.folder}/{self.number}.beat", self.owner, replace=True)

    def _renew(self) -> None:
        while not self._stop.wait(max(self.seconds / 3, 0.05)):
            with contextlib.suppress(Exception):  # a file system that is away for a while: the next time
                if not self.held():
                    return
                self.renew()

    def release(self) -> None:
        """Give it back. The highest number stays, so that the next one is higher."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join(timeout=5)
        if self.held():
            self.files.create(f"{self.folder}/{self.number}.done", self.owner, replace=True)


@contextlib.contextmanager
def single_flight(spark: SparkSession, root: str, lease: float = LEASE) -> Iterator[Lease]:
    """One run at a time on a state root, whichever driver it is on; a second one is turned away, not queued.

    A lock file of an earlier release counts as a run until it is older than ``lease`` seconds.
    """
    files, lock = Files(spark), f"{root.rstrip('/')}/lock"
    if files.exists(lock):
        if files.age(lock) < lease:
            raise Busy(f"a run is already under way: {lock}")
        files.delete(lock)
    held = Lease(spark, root, lease).take()
    try:
        yield held
    finally:
        held.release()
