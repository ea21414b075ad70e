"""Files and small catalogs on whatever storage the session's paths name, by Hadoop's file systems."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Storage:
    """The few operations on folders that logs, states and catalogs need."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def drop(self, path: str) -> None:
        """With all that is in it; nothing if it is not there."""
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"cannot move {old} to {new}")

    def names(self, path: str) -> list[str]:
        """What is in a folder; nothing if there is none."""
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not be there yet; False if it is."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True


class Catalog:
    """Names to JSON values, in a folder of numbered versions. A version is complete once the mark beside it
    stands; of two writers of the same version one fails to create it and starts from the other's."""

    KEPT = 3

    def __init__(self, storage: Storage, path: str):
        self.storage, self.path = storage, path

    def _newest(self) -> int:
        found = (re.fullmatch(r"(\d+)\.done", n) for n in self.storage.names(self.path))
        return max((int(m[1]) for m in found if m), default=0)

    def read(self) -> dict:
        v = self._newest()
        return json.loads(self.storage.read(f"{self.path}/{v}.json")) if v else {}

    def change(self, how: Callable[[dict], dict]) -> None:
        while True:
            v = self._newest()
            own = how(json.loads(self.storage.read(f"{self.path}/{v}.json")) if v else {})
            if not self.storage.create(f"{self.path}/{v + 1}.json", json.dumps(own, sort_keys=True)):
                if not self.storage.exists(f"{self.path}/{v + 1}.done"):
                    # its writer is at work, or has died before the mark
                    self._settle(v + 1)
                continue
            self.storage.create(f"{self.path}/{v + 1}.done", "")
            for old in (v + 1 - self.KEPT,):
                if old > 0:
                    self.storage.drop(f"{self.path}/{old}.done")
                    self.storage.drop(f"{self.path}/{old}.json")
            return

    def _settle(self, v: int) -> None:
        """Marks a version whose text is whole, else takes it away."""
        try:
            json.loads(self.storage.read(f"{self.path}/{v}.json"))
        except (ValueError, Py4JJavaError):
            self.storage.drop(f"{self.path}/{v}.json")
        else:
            self.storage.create(f"{self.path}/{v}.done", "")

    def put(self, name: str, value: object) -> None:
        self.change(lambda own: own | {name: value})

    def drop(self, name: str) -> None:
        self.change(lambda own: {k: v for k, v in own.items() if k != name})
