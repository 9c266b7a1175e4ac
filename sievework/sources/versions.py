"""Tables as immutable folders under numbered versions.

Data is written to folders of its own first; a version is one small file that names the folders of every table,
and it is put in place last, by a rename that fails if the number is taken. So readers see a whole version or the
one before, a write that fails changes nothing, two writers can't both win, and a snapshot or a restore moves a
pointer and no data.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: How a snapshot may be called, and the characters of its label that are kept.
SNAPSHOT_ID, LABEL = r"[0-9T:-]+", 60


class Conflict(Exception):
    """Another version was put in place first."""


@dataclass
class Version:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Versions:
    """A folder of versions, in any file system that Spark's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _load(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, what: dict) -> None:
        """Writes a file that isn't there yet, whole or not at all."""
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(what).encode()))
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        target = self._path(name)
        self.fs.mkdirs(target.getParent())
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.conf).rename(draft, target, how)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    # --- versions ---

    def current(self) -> Version:
        """The version put in place last; an empty one of number 0 before the first."""
        names = self._names("versions")
        return Version(**self._load(f"versions/{names[-1]}")) if names else Version()

    def commit(self, base: Version, tables: dict[str, list[str]], facts: dict) -> Version:
        """Puts the version after ``base`` in place; ``Conflict`` if there is one already. Tables that aren't named stay."""
        new = Version(base.number + 1, {k: v for k, v in (base.tables | tables).items() if v}, base.facts | facts)
        self._put(f"versions/{new.number:012d}.json", asdict(new))
        return new

    def write(self, name: str, df: DataFrame, group: int | None = None) -> str:
        """Writes a folder of a table, which no version names yet. ``group``: bytes of a row group, the least that a task reads of a file."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        (df.write.option("parquet.block.size", group) if group else df.write).parquet(f"{self.root}/{folder}")
        return folder

    def read(self, version: Version, name: str) -> DataFrame | None:
        """All folders of a table; None if there is none."""
        folders = version.tables.get(name)
        if not folders:
            return None
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders))

    def bytes_of(self, version: Version) -> int:
        return sum(self.fs.getContentSummary(self._path(f)).getLength() for folders in version.tables.values() for f in folders)

    # --- snapshots ---

    def snapshot(self, label: str = "", rows: int = 0, configs: dict[str, str] | None = None) -> str:
        """Names the current version, so that its folders stay; ``configs``: small texts kept with it."""
        now = self.current()
        taken = set(self._names("snapshots"))
        at = time.time()
        while (made := time.strftime("%Y-%m-%dT%H-%M-%S", time.gmtime(at))) + ".json" in taken:
            at += 1
        info = {"id": made, "label": str(label or "")[:LABEL], "rows": rows, "bytes": self.bytes_of(now), "configs": configs or {}, "version": asdict(now)}
        self._put(f"snapshots/{made}.json", info)
        return made

    def _snapshot_file(self, snapshot: str) -> str:
        if not re.fullmatch(SNAPSHOT_ID, str(snapshot or "")):
            raise ValueError(f"no snapshot is called so: {snapshot!r}")
        return f"snapshots/{snapshot}.json"

    def snapshots(self) -> list[dict]:
        """id, label, rows, bytes and names of configs of each snapshot, newest first."""
        out = []
        for name in reversed(self._names("snapshots")):
            info = self._load(f"snapshots/{name}")
            out.append({k: info[k] for k in ("id", "label", "rows", "bytes")} | {"configs": sorted(info["configs"])})
        return out

    def restore(self, snapshot: str) -> tuple[Version, dict[str, str]]:
        """Makes a snapshot's tables and facts the current version, and gives back its configs. No data moves."""
        file = self._snapshot_file(snapshot)
        if not self.fs.exists(self._path(file)):
            raise ValueError(f"there is no snapshot {snapshot}")
        info = self._load(file)
        now = self.current()
        new = Version(now.number + 1, info["version"]["tables"], info["version"]["facts"])
        self._put(f"versions/{new.number:012d}.json", asdict(new))
        return new, info["configs"]

    def forget(self, snapshot: str) -> bool:
        """Deletes a snapshot's name; False if there is none. ``clean`` then takes its folders."""
        at = self._path(self._snapshot_file(snapshot))
        return self.fs.exists(at) and self.fs.delete(at, False)

    def clean(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions, and folders that neither they nor a snapshot name. Run it while nothing writes."""
        names = self._names("versions")
        for name in names[:-keep]:
            self.fs.delete(self._path(f"versions/{name}"), False)
        held = [self._load(f"versions/{n}") for n in names[-keep:]] + [self._load(f"snapshots/{n}")["version"] for n in self._names("snapshots")]
        used = {f for v in held for folders in v["tables"].values() for f in folders}
        gone = [n for n in self._names("data") if f"data/{n}" not in used]
        for n in gone:
            self.fs.delete(self._path(f"data/{n}"), True)
        return len(gone)
