"""A log of numbered versions in a folder: what each file of it says is whole and final.

A version is one small JSON file. It is written aside and published under its
number by an operation that fails if that number is there already: a hard link
on a local file system, a rename without overwriting elsewhere. So of two
writers with the same number one is told to try again on top of the other, and a
reader sees a version whole or not at all.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

NAME = re.compile(r"(\d{20})\.json")


class Folder:
    """A folder on any file system that Spark reaches, with the few operations that stores need."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.settings = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.files = self._place("").getFileSystem(self.settings)

    def _place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def local(self) -> bool:
        return self.files.getUri().getScheme() == "file"

    def _here(self, name: str) -> str:
        return self.files.makeQualified(self._place(name)).toUri().getPath()

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self._place(name))

    def names(self, name: str = "") -> list[str]:
        """What is in the folder; nothing if it isn't there."""
        return [s.getPath().getName() for s in self.files.listStatus(self._place(name))] if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return (self.jvm.System.currentTimeMillis() - self.files.getFileStatus(self._place(name)).getModificationTime()) / 1000

    def matching(self, pattern: str) -> list[str]:
        """Paths below the folder that a pattern names."""
        root = self.files.makeQualified(self._place("")).toUri().getPath().rstrip("/") + "/"
        return sorted(s.getPath().toUri().getPath().removeprefix(root) for s in self.files.globStatus(self._place(pattern)) or [])

    def delete(self, name: str = "") -> None:
        self.files.delete(self._place(name), True)

    def read(self, name: str) -> str:
        stream = self.files.open(self._place(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, whole or not at all; whether it was this call that did."""
        aside = f"{os.path.dirname(name)}/.aside-{uuid.uuid4().hex}".lstrip("/")
        if self.local:
            return self._linked(self._here(aside), self._here(name), text)
        stream = self.files.create(self._place(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.settings)
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(self._place(aside), self._place(name), none)
            return True
        except Py4JJavaError:
            self.files.delete(self._place(aside), True)
            if self.exists(name):
                return False
            raise

    @staticmethod
    def _linked(aside: str, target: str, text: str) -> bool:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(aside, "x") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(aside, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)


class VersionLog:
    """Versions 1, 2, ... in a folder; each holds a dictionary."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(NAME.fullmatch, self.folder.names()) if m)

    def last(self) -> tuple[int, dict]:
        """The newest version and what it holds; 0 and nothing before the first."""
        while True:
            number = max(self.numbers(), default=0)
            if not number:
                return 0, {}
            try:
                return number, self.read(number)
            except Py4JJavaError:
                if number in self.numbers():
                    raise  # not cleaned away meanwhile: a real failure

    def read(self, number: int) -> dict:
        return json.loads(self.folder.read(f"{number:020}.json"))

    def publish(self, number: int, content: dict) -> bool:
        """Make ``content`` the version of that number; False if another writer has."""
        return self.folder.create(f"{number:020}.json", json.dumps(content, sort_keys=True))

    def forget(self, keep: int) -> list[int]:
        """Delete all but the newest versions; the numbers that are left."""
        numbers = self.numbers()
        kept = numbers[-max(1, keep) :]
        for number in numbers[: -len(kept)] if kept else []:
            self.folder.delete(f"{number:020}.json")
        return kept
