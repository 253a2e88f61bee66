"""Folders in any file system that Spark reaches, and versioned documents in them."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import Code, EngineError


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; without it a local one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise EngineError(Code.InvalidArgument, "spark.checkpoint.dir has to name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "tessera-tables")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """File operations by Hadoop's interface, so that local, cluster and object stores are alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        if not self._fs.exists(self._at(name)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if it is there already. The file appears whole and at once.

        It is written under another name and then published by one step that fails if the name is
        taken: a hard link in a local file system, else a rename that doesn't overwrite. A writer
        that dies before that step leaves nothing that others could meet.
        """
        staged, wanted = self._at(f".staged-{uuid.uuid4().hex}"), self._at(name)
        self._fs.mkdirs(wanted.getParent())
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            return self._publish(staged, wanted)
        finally:
            self._fs.delete(staged, False)

    def _publish(self, staged, wanted) -> bool:
        jvm, jsc = self._jvm, self.spark.sparkContext._jsc
        try:
            if self._fs.getUri().getScheme() == "file":
                path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(path(wanted), path(staged))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
                context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(wanted), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(wanted):
                return False
            raise EngineError(Code.IoError, str(e.java_exception)) from e

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class Versions:
    """A JSON document as numbered files: the last counts, and a change is a new file that nobody else has made.

    The last ``KEPT`` versions stay for readers that have just looked; older ones are deleted.
    """

    KEPT = 8

    def __init__(self, folder: Folder, empty: dict):
        self._folder, self._empty = folder, empty

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._folder.names() if n.startswith("v") and n.endswith(".json"))

    def _now(self, tries: int = 20) -> tuple[list[int], dict]:
        """The versions that are there and the content of the last; looks again if that was pruned meanwhile."""
        for attempt in range(tries):
            numbers = self._numbers()
            if not numbers:
                return [0], json.loads(json.dumps(self._empty))
            try:
                return numbers, json.loads(self._folder.read(f"v{numbers[-1]:012d}.json"))
            except Py4JJavaError as e:
                if attempt == tries - 1 or "FileNotFound" not in e.java_exception.getClass().getName():
                    raise EngineError(Code.IoError, str(e.java_exception)) from e
        raise AssertionError

    def read(self) -> dict:
        return self._now()[1]

    def change(self, edit: Callable[[dict], None], tries: int = 200) -> dict:
        """Applies ``edit`` to the last version and publishes the outcome; starts again if another writer came first."""
        for attempt in range(tries):
            numbers, state = self._now()
            edit(state)
            if self._folder.create(f"v{numbers[-1] + 1:012d}.json", json.dumps(state)):
                for old in numbers[: -self.KEPT]:
                    self._folder.delete(f"v{old:012d}.json")
                return state
            time.sleep(min(0.01 * (attempt + 1), 0.2))
        raise EngineError(Code.IoError, f"no version of {self._folder.path} could be published")
