"""Files beside the tables: objects under a prefix and the sidecars of a document, through any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class ObjectStore:
    """Objects by key under one root: a local folder, an object store or HDFS, as the root's scheme says."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):
        if any(part in ("", ".", "..") for part in key.split("/")):
            raise ValueError(f"no key of an object: {key!r}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: str, content: bytes) -> str:
        """Writes an object, in place of one with its key, and gives its address."""
        path, fs = self._at(key)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        return str(path)

    def get(self, key: str) -> bytes | None:
        path, fs = self._at(key)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, prefix: str) -> bool:
        """Deletes an object, or everything below a prefix."""
        path, fs = self._at(prefix)
        return bool(fs.delete(path, True))


def put_sidecar(store: ObjectStore, doc_id: str, version: str, markdown: str, anchors: dict[str, tuple[int, int]], blocks: list[dict]) -> str:
    """Writes a document's Markdown, anchors and blocks; the file that names the version comes last, so readers never see half."""
    folder = f"{doc_id}/{version}"
    store.put(f"{folder}/text.md", markdown.encode())
    store.put(f"{folder}/anchors.json", json.dumps(anchors).encode())
    store.put(f"{folder}/blocks.json", json.dumps(blocks).encode())
    return store.put(f"{doc_id}/CURRENT", version.encode())


def sidecar(store: ObjectStore, doc_id: str) -> tuple[str, dict, list] | None:
    """(Markdown, anchors, blocks) of the version that stands, None without one."""
    version = store.get(f"{doc_id}/CURRENT")
    if version is None:
        return None
    folder = f"{doc_id}/{version.decode()}"
    read = lambda name: (store.get(f"{folder}/{name}") or b"").decode()
    return read("text.md"), json.loads(read("anchors.json")), json.loads(read("blocks.json"))


def check_profile(store: ObjectStore, table: str, profile: dict) -> dict:
    """Pins the profile of an index (model, dimensions, partitions) at its first use; another one later is an error."""
    known = store.get(f"{table}/PROFILE")
    if known is None:
        store.put(f"{table}/PROFILE", json.dumps(profile, sort_keys=True).encode())
        return profile
    if json.loads(known) != profile:
        raise ValueError(f"the index {table} was made with another profile")
    return profile
