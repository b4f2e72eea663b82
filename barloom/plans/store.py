"""Versions of derived tables: built once, published as a whole, read by name.

A version is named by everything that its tables depend on (``derived.fingerprint``). A builder
writes its tables to folders of its own and publishes them by one manifest, written aside and renamed
last; a rename to a name that is taken fails. So all tables of a version appear at once or not at
all, the manifest that comes first stays for good, and readers never see a half-written table or files
that another builder removes.

Before it starts, a builder claims the version by creating a file that must not exist yet. Another
one that finds the claim waits for the manifest and builds by itself only if the claim grows older
than ``lease`` seconds, for its owner may be lost. The claim saves work, the rename alone decides.

The guarantees are those of the file system: creating and renaming must be atomic and refuse an
existing target, as on HDFS. Object stores without such a rename need a table format in its place.
"""
from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructType

from barloom.sources.feeds import write_table

#: Writes tables under a folder with ``Store.write`` and returns what that gave, by name.
Build = Callable[[str], dict[str, dict]]


def _taken(error: Py4JJavaError) -> bool:
    """Whether the target of a create or rename was there already, said by type or in words."""
    text = str(error.java_exception)
    return "AlreadyExists" in text or "already exists" in text


class Store:
    def __init__(self, spark: SparkSession, folder: str, lease: float = 3600.0,
                 wait: float = 1.0):
        self.spark, self.folder, self.lease, self.wait = spark, folder.rstrip("/"), lease, wait
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = fs.Path
        root = fs.Path(self.folder)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(conf)
        self._names = fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(
            spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(root)

    def _file(self, name: str):
        return self._fs.makeQualified(self._path(f"{self.folder}/{name}"))

    def _local(self, name: str) -> str | None:
        """The plain path of a file where the store lies on a local disk. Hadoop's classes test
        and write there in two steps; the system's own calls refuse an existing name in one."""
        uri = self._file(name).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def _create(self, name: str, text: str) -> bool:
        """Write a new file; False if the name is taken."""
        local = self._local(name)
        try:
            if local is not None:
                with open(local, "x") as f:
                    f.write(text)
            else:
                out = self._fs.create(self._file(name), False)
                out.write(bytearray(text.encode()))
                out.close()
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if not _taken(e):
                raise
            return False
        return True

    def _rename(self, name: str, to: str) -> bool:
        """Give a file its final name; False, and the file goes, if that is taken."""
        local = self._local(name)
        done = True
        try:
            if local is not None:
                os.link(local, self._local(to))
            else:
                self._names.rename(self._file(name), self._file(to), self._plain)
                return True
        except FileExistsError:
            done = False
        except Py4JJavaError as e:
            if not _taken(e):
                raise
            done = False
        self._fs.delete(self._file(name), False)
        return done

    def manifest(self, version: str) -> dict | None:
        """The published manifest of a version, if there is one."""
        path = self._file(f"manifest-{version}.json")
        if not self._fs.exists(path):
            return None
        text = self.spark.read.text(path.toString(), wholetext=True).first()
        return json.loads(text[0])

    def write(self, df: DataFrame, path: str) -> dict:
        """Store a table in folders by year; path and schema, for an empty one has no files."""
        write_table(df, path)
        return {"path": path, "schema": df.schema.json()}

    def read(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"])).add("year", IntegerType())
        return self.spark.read.schema(schema).parquet(entry["path"]).drop("year")

    def publish(self, version: str, tables: dict[str, dict], **facts) -> dict:
        """Publish tables under a version; where another builder was first, its manifest."""
        aside = f"aside-{uuid.uuid4().hex}"
        self._create(aside, json.dumps({"version": version, "tables": tables, **facts}))
        self._rename(aside, f"manifest-{version}.json")
        return self.manifest(version)

    def claim(self, version: str) -> bool:
        """Whether this caller may start to build; a claim older than the lease counts no more."""
        name = f"claim-{version}"
        if self._create(name, ""):
            return True
        written = self._fs.getFileStatus(self._file(name)).getModificationTime() / 1000.0
        return time.time() - written > self.lease

    def get_or_build(self, version: str, build: Build, **facts) -> dict:
        """The manifest of a version, which is built if nobody has built it."""
        while True:
            found = self.manifest(version)
            if found is not None:
                return found
            if self.claim(version):
                tables = build(f"{self.folder}/data-{uuid.uuid4().hex}")
                return self.publish(version, tables, **facts)
            time.sleep(self.wait)

    def table(self, version: str, name: str) -> DataFrame:
        """A table of a published version."""
        found = self.manifest(version)
        if found is None:
            raise LookupError(f"no version {version} in {self.folder}")
        return self.read(found["tables"][name])
