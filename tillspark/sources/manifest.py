"""Numbered manifests that name the folders of a table; a new one appears by a rename.

Readers see what one manifest names, whole. Folders written for a manifest that never appeared
are named nowhere; writing them again under the same name, or a vacuum, takes care of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        if not self._files.exists(path):
            return []
        return [s.getPath().getName() for s in self._files.listStatus(path)]

    def delete(self, folder: str) -> None:
        self._files.delete(self._path(f"{self.root}/{folder}"), True)

    def newest(self) -> dict | None:
        versions = [int(n.split(".")[0]) for n in self.listed("manifests") if n.endswith(".json")]
        return self.numbered(max(versions)) if versions else None

    def numbered(self, version: int) -> dict | None:
        path = self._path(f"{self.root}/manifests/{version}.json")
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Makes ``manifest`` the next version; fails if another writer was first."""
        spare = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifests/{manifest['version']}.json")
        out = self._files.create(spare)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._files.exists(final) or not self._files.rename(spare, final):
            raise RuntimeError(f"version {manifest['version']} exists already")

    def forget_older(self, manifest: dict) -> None:
        for name in self.listed("manifests"):
            if name != f"{manifest['version']}.json":
                self.delete(f"manifests/{name}")
