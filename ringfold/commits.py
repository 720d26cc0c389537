"""Small named texts, each stored once, whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


class CommitLog:
    """A folder with a file per name. A text is written aside and then renamed, so no reader sees half of it.

    A name has one writer at a time, which may be started again; what it stored first stays.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._jvm = spark, spark._jvm
        self.path = path.rstrip("/")
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def get(self, name: str) -> str | None:
        file = self._file(name)
        if not self._fs.exists(file):
            return None
        source = self._fs.open(file)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def put(self, name: str, text: str) -> str:
        """Store a text under a name, if there is none yet; return the stored one."""
        if (there := self.get(name)) is not None:
            return there
        aside = self._file(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(aside, self._file(name)):
            self._fs.delete(aside, False)
            if (there := self.get(name)) is None:
                raise OSError(f"{name} could not be stored below {self.path}")
            return there
        return text

    def texts(self) -> list[str]:
        """All stored texts of one line each, in the order of their names."""
        try:
            rows = self._spark.read.text(self.path).select("_metadata.file_name", "value").collect()
        except AnalysisException:
            return []
        return [r["value"] for r in sorted(rows)]
