"""Tables that are rebuilt beside the ones in use, and swapped by one pointer.

A folder holds generations/<name>/<table> and pointers/<number>, files with the name of a generation. A rebuild writes its
steps into its own generation; a step is done when its _SUCCESS is there, so a rebuild that broke off goes on at the first
step it hasn't done. publish() then makes the next pointer: it is written aside and renamed to a number that isn't taken,
which the file system grants to one writer only. Readers take the highest pointer when they begin and stay with that
generation: a swap, or a broken rebuild, never shows them parts of two. collect() removes the generations that neither the
last `keep` pointers nor a given pin name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.runtime import _filesystem


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, path: str) -> list[str]:
        fs, p = _filesystem(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _exists(self, path: str) -> bool:
        fs, p = _filesystem(self.spark, path)
        return fs.exists(p)

    def _pointers(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.folder}/pointers") if n.isdigit())

    def _read(self, number: int) -> str:
        return self.spark.read.text(f"{self.folder}/pointers/{number:08d}", wholetext=True).first()[0].strip()

    def current(self) -> str | None:
        """The generation that readers see now: what a reader pins."""
        numbers = self._pointers()
        return self._read(numbers[-1]) if numbers else None

    def has(self, name: str) -> bool:
        """Whether a generation was published."""
        return self._exists(f"{self.folder}/published/{name}")

    def table(self, table: str, schema: str, pin: str | None = None) -> DataFrame:
        """A table of the pinned generation or the current one; empty if it has none."""
        name = pin or self.current()
        path = f"{self.folder}/generations/{name}/{table}"
        if name is None or not self._exists(f"{path}/_SUCCESS"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def stage(self, name: str, step: str, rows: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        """A step of generation `name`, written unless an earlier attempt has done so, and read back."""
        path = f"{self.folder}/generations/{name}/{step}"
        if not self._exists(f"{path}/_SUCCESS"):
            (rows() if callable(rows) else rows).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def publish(self, name: str, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> None:
        """Writes what isn't there yet of a generation's tables and shows it to readers. A published one stays as it is."""
        if self.has(name):
            return
        for table, rows in tables.items():
            self.stage(name, table, rows)
        fs, aside = _filesystem(self.spark, f"{self.folder}/aside/{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(name.encode()))
        out.close()
        while True:
            _, to = _filesystem(self.spark, f"{self.folder}/pointers/{(self._pointers() or [0])[-1] + 1:08d}")
            fs.mkdirs(to.getParent())
            if not fs.exists(to) and fs.rename(aside, to):
                break
        fs.mkdirs(_filesystem(self.spark, f"{self.folder}/published/{name}")[1])

    def collect(self, keep: int = 2, pins: tuple[str, ...] = ()) -> list[str]:
        """Removes generations that were published before the last `keep` and aren't pinned; their names."""
        used = {self._read(n) for n in self._pointers()[-keep:]} | set(pins)
        gone = [n for n in self._names(f"{self.folder}/generations") if n not in used and self.has(n)]
        for n in gone:
            fs, p = _filesystem(self.spark, f"{self.folder}/generations/{n}")
            fs.delete(p, True)
        return sorted(gone)
