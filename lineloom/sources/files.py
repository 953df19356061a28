"""Files by the Hadoop file system of the session: whatever Spark reads, the driver reads too."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs, self._io = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.io.IOUtils
        self._path, self._gateway = self._fs.Path, spark._sc._gateway

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def status(self, path: str) -> tuple[str, int, int]:
        """(qualified path, bytes, time of modification in milliseconds)."""
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        s = fs.getFileStatus(p)
        return s.getPath().toString(), s.getLen(), s.getModificationTime()

    def head(self, path: str, size: int) -> bytes:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def read(self, path: str) -> bytes:
        return self.head(path, 0x7FFFFFF0)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, draft, place, overwrite: bool = False) -> None:
        """Rename in one step, which replaces a file only if it is to."""
        jvm_conf, rename = self._conf, getattr(self._fs, "Options$Rename")
        try:
            files = self._fs.FileContext.getFileContext(place.toUri(), jvm_conf)
        except Py4JJavaError as e:
            if "UnsupportedFileSystem" not in e.java_exception.getClass().getName():
                raise
            files = None
        if files is None:  # a file system that has no such step
            fs = place.getFileSystem(jvm_conf)
            if fs.exists(place):
                if not overwrite:
                    raise FileExistsError(str(place))
                fs.delete(place, False)
            if not fs.rename(draft, place):
                raise OSError(f"could not move the result to {place}")
            return
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            files.rename(draft, place, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(str(place)) from e
            raise

    def bring(self, draft: str, path: str) -> None:
        """Move a whole file to a place where there is none."""
        fs, p = self._at(path)
        if p.getParent() is not None and not fs.exists(p.getParent()):
            fs.mkdirs(p.getParent())
        self.move(self._path(draft), p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def append(self, stream, path: str) -> None:
        """Copy a file to the end of an open stream, by the JVM."""
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            self._io.copyBytes(source, stream, 1 << 20, False)
        finally:
            source.close()

    @contextlib.contextmanager
    def writing(self, path: str, overwrite: bool = False) -> Iterator:
        """What takes bytes, or the path of a file to copy, for a file that appears at ``path`` as a whole, or not at all."""
        fs, p = self._at(path)
        if not overwrite and fs.exists(p):
            raise FileExistsError(path)
        if p.getParent() is not None:
            fs.mkdirs(p.getParent())
        draft = self._path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(draft, False)
        try:
            yield lambda data: stream.write(bytearray(data)) if isinstance(data, bytes) else self.append(stream, data)
            stream.hsync()
            stream.close()
            self.move(draft, p, overwrite)
        except BaseException:
            with contextlib.suppress(Exception):
                stream.close()
            fs.delete(draft, False)
            raise


def _numbered(spark: SparkSession, folder: str, stem: str, ending: str) -> str:
    files, k = Files(spark), 1
    while files.exists(path := f"{folder}/{stem}{'' if k == 1 else f'_{k}'}{ending}"):
        k += 1
    return path


def unique_path(spark: SparkSession, path: str, suffix: str) -> str:
    """A free name beside ``path``: stem, suffix, ending; then _2, _3 and so on after the suffix."""
    folder, _, name = path.rpartition("/")
    stem, dot, ending = name.rpartition(".")
    stem, ending = (stem, dot + ending) if dot else (name, "")
    return _numbered(spark, folder or ".", stem + suffix, ending)


def unique_directory(spark: SparkSession, path: str, suffix: str) -> str:
    """A free name for a folder beside ``path``."""
    folder, _, name = path.rpartition("/")
    return _numbered(spark, folder or ".", (name.rpartition(".")[0] or name) + suffix, "")
