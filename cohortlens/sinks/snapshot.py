"""A report materialised once and reused while it is fresh."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

# Fixed value: a snapshot serves requests less than this long after its own moment.
MAX_AGE = timedelta(seconds=300)

#: How long a writer may take before what it left is deleted.
ABANDONED = timedelta(days=1)

_STAMP = "%Y%m%dT%H%M%S.%fZ"
_POINTER, _DATA = "published_", "data_"


def _utc(as_of: datetime | str) -> datetime:
    when = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)


class _Store:
    """Snapshots under one path: data folders, and empty files that publish them by their name.

    An empty file is there or not, so a reader finds a whole snapshot or none, however many write at once.
    All goes through Hadoop's file system interface, so that any shared storage will do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.root = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def named(self, prefix: str) -> list[tuple[datetime, str]]:
        """Moment and name of everything that begins with ``prefix``, oldest first."""
        if not self._files.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.root))]
        found = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
        return sorted((datetime.strptime(n.partition("-")[0], _STAMP).replace(tzinfo=UTC), n) for n in found)

    def folder(self, name: str) -> str:
        return f"{self.root}/{_DATA}{name}"

    def whole(self) -> list[tuple[datetime, str]]:
        """The published snapshots; a folder that has lost its success marker is none."""
        return [
            (s, n) for s, n in self.named(_POINTER) if self._files.exists(self._path(f"{self.folder(n)}/_SUCCESS"))
        ]

    def publish(self, name: str) -> None:
        self._files.create(self._path(f"{self.root}/{_POINTER}{name}"), False).close()

    def delete(self, name: str) -> None:
        # The pointer first: what is published is whole.
        for prefix in (_POINTER, _DATA):
            self._files.delete(self._path(f"{self.root}/{prefix}{name}"), True)


def snapshot(
    spark: SparkSession,
    path: str,
    as_of: datetime | str,
    build: Callable[[], DataFrame],
    max_age: timedelta = MAX_AGE,
) -> DataFrame:
    """The newest snapshot under ``path`` that is fresh at ``as_of``, else a new one from ``build``.

    A reused snapshot keeps the clock-dependent values of its own moment.  A new one is written to a folder of its own
    and published when it is whole; of several for one moment, all callers read the same.
    """
    now = _utc(as_of)
    store = _Store(spark, path)

    def fresh() -> list[tuple[datetime, str]]:
        return [(s, n) for s, n in store.whole() if timedelta(0) <= now - s < max_age]

    if not fresh():
        mine = f"{now.strftime(_STAMP)}-{uuid.uuid4().hex}"
        build().write.parquet(store.folder(mine))
        store.publish(mine)
        if any(s == now and n < mine for s, n in fresh()):
            store.delete(mine)  # another writer's snapshot of this moment is the one that is read
    newest = max(s for s, _ in fresh())
    return spark.read.parquet(store.folder(min(n for s, n in fresh() if s == newest)))


def expire(
    spark: SparkSession,
    path: str,
    as_of: datetime | str,
    max_age: timedelta = MAX_AGE,
    abandoned: timedelta = ABANDONED,
) -> int:
    """Delete the snapshots that are no longer fresh at ``as_of``, and what writers left more than ``abandoned`` ago.

    Returns how many were deleted.  Who may still read an old snapshot should expire with a longer ``max_age``.
    """
    now = _utc(as_of)
    store = _Store(spark, path)
    published = store.named(_POINTER)
    old = [n for s, n in published if now - s >= max_age]
    known = {n for _, n in published}
    old += [n for s, n in store.named(_DATA) if n not in known and now - s >= max_age + abandoned]
    for name in old:
        store.delete(name)
    return len(old)
