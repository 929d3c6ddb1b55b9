"""A versioned table store: every write is a new folder, and a numbered pointer makes it the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleTable(RuntimeError):
    """Another writer has changed the table since it was read; read it again and repeat."""


class Store:
    """Tables as ``base/name/version`` folders of Parquet, and pointers ``base/name/_current-NUMBER`` that hold a version.

    The pointer of the highest number counts. A write makes its folder first, with a pointer beside it that doesn't count yet, and then
    moves that pointer to the next number, which fails if the number is taken. So a crash at any step leaves the table as it was, no version is removed
    before a newer one is current, and of two writers that started from the same version one gets a ``StaleTable`` error
    instead of undoing the other. A folder that no pointer speaks of, where there is no current one, is
    an error, never an empty table.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.seen = spark, base.rstrip("/"), {}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[tuple[str, bool]]:
        """(name, whether it is a folder) of what lies in a folder; nothing if there is none."""
        at = self._path(*parts)
        return [(s.getPath().getName(), s.isDirectory()) for s in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def _pointers(self, name: str) -> list[int]:
        found = self._list(name)
        numbers = sorted(int(n.removeprefix("_current-")) for n, folder in found if n.startswith("_current-") and not folder)
        at_work = {n.removeprefix("_next-") for n, folder in found if not folder}
        if not numbers and any(folder and n not in at_work for n, folder in found):
            raise OSError(f"{name} has versions but no pointer to the current one")
        return numbers

    def _pointed(self, name: str, number: int) -> str:
        stream = self._fs().open(self._path(name, f"_current-{number:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self, name: str) -> str | None:
        numbers = self._pointers(name)
        return self._pointed(name, numbers[-1]) if numbers else None

    def read(self, name: str, schema=None) -> DataFrame:
        """The current version; an empty table of ``schema`` if there is none. A later ``write`` of this store goes through only if nobody wrote in between."""
        numbers = self._pointers(name)
        self.seen[name] = numbers[-1] if numbers else 0
        if not numbers:
            if schema is None:
                raise FileNotFoundError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.base}/{name}/{self._pointed(name, numbers[-1])}")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Writes a new version and makes it current. The last ``KEPT`` versions stay for readers; older ones go."""
        numbers = self._pointers(name)
        base = self.seen.get(name, numbers[-1] if numbers else 0)
        version = uuid.uuid4().hex
        out = self._fs().create(self._path(name, f"_next-{version}"), True)
        out.write(bytearray(version.encode()))
        out.close()
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.base}/{name}/{version}")
        self._point(name, base + 1, version)
        self.seen[name] = base + 1
        self._forget(name, base + 1)
        return version

    def _point(self, name: str, number: int, version: str) -> None:
        jvm, latest = self.spark._jvm, self._pointers(name)
        new, at = self._path(name, f"_next-{version}"), self._path(name, f"_current-{number:012d}")
        if latest and latest[-1] >= number:
            self._abandon(name, version)
            raise StaleTable(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, at, never)  # refuses to overwrite
        except Exception as e:
            if self._fs().exists(at) and self._fs().exists(new):
                self._abandon(name, version)
                raise StaleTable(name) from e
            raise

    def _abandon(self, name: str, version: str) -> None:
        self._fs().delete(self._path(name, version), True)
        self._fs().delete(self._path(name, f"_next-{version}"), False)

    def _forget(self, name: str, number: int) -> None:
        """Removes versions that ``KEPT`` newer ones have followed, data before pointer; folders of writers at work have no pointer and stay."""
        for old in [n for n in self._pointers(name) if n <= number - self.KEPT]:
            self._fs().delete(self._path(name, self._pointed(name, old)), True)
            self._fs().delete(self._path(name, f"_current-{old:012d}"), False)

    def tables(self) -> list[str]:
        return sorted(n for n, folder in self._list() if folder and self._pointers(n))

    def register_views(self) -> None:
        """Makes every table a temporary view of its name, for the console."""
        for name in self.tables():
            self.read(name).createOrReplaceTempView(name)
