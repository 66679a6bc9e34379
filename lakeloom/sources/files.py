"""Small files and folders by any path that Spark's file systems open."""

from __future__ import annotations

import json
import os
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, old: str, new: str) -> None:
        p, fs = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"can't move {old} to {new}")

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        p, fs = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else 0.0

    def stamps(self, path: str) -> list[list]:
        """Name, bytes and time of a file, or of all files of a folder."""
        p, fs = self._at(path)
        found, each = [], fs.listFiles(p, True)
        while each.hasNext():
            s = each.next()
            found.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
        return sorted(found)

    def size(self, path: str) -> int:
        """Bytes of a file or of all files of a folder."""
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def create_json(self, path: str, value: Any) -> bool:
        """Write a file whole, unless there is one: of several writers one is told that it was the one."""
        to, fs = self._at(path)
        aside, _ = self._at(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        body = json.dumps(value, default=str).encode()
        if fs.getScheme() == "file":  # here a rename would replace; a link doesn't
            here, at = to.toUri().getPath(), aside.toUri().getPath()
            os.makedirs(os.path.dirname(here), exist_ok=True)
            with open(at, "wb") as f:
                f.write(body)
            try:
                os.link(at, here)
            except FileExistsError:
                return False
            finally:
                os.remove(at)
            return True
        out = fs.create(aside, True)
        out.write(bytearray(body))
        out.close()
        from py4j.protocol import Py4JJavaError
        from pyspark import SparkContext

        none = SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(aside, to, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.toString():
                raise
            fs.delete(aside, False)
            return False
        return True

    def read_json(self, path: str) -> Any:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write_json(self, path: str, value: Any) -> None:
        """Written aside and moved over the old file in one step."""
        aside, _ = self._at(path + ".new")
        to, fs = self._at(path)
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(value, default=str).encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        from pyspark import SparkContext

        kinds = SparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(aside, to, kinds)
