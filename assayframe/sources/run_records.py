"""Records of runs as numbered snapshots: every change is a new file that names the next number, and only one writer can have a number.

A writer reads the latest snapshot, merges its change and claims the number after it. If another
has claimed that meanwhile, it reads again and merges anew, so nothing is lost and the later
write wins. Old snapshots are deleted behind the latest KEEP.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

KEEP = 20
ATTEMPTS = 1_000
_NAME = re.compile(r"snapshot-(\d{9})\.json")
_SCHEMA = "run_id string, stage string, at string, payload string"


class Store:
    """A run's folder, wherever Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str, run_id: str) -> None:
        jvm = spark._jvm  # noqa: SLF001
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
        self.gateway = spark.sparkContext._gateway  # noqa: SLF001
        self.jvm, self.folder = jvm, jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{run_id}")
        self.fs = self.folder.getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(m.group(1)) for s in self.fs.listStatus(self.folder) if (m := _NAME.fullmatch(s.getPath().getName())))

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"snapshot-{number:09d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, record); number 0 where there is none. A snapshot may be deleted between listing and reading, and then there are later ones."""
        for _ in range(ATTEMPTS):
            numbers = self.numbers()
            if not numbers:
                return 0, {}
            try:
                return numbers[-1], self.read(numbers[-1])
            except Exception:
                if self.numbers()[-1:] == numbers[-1:]:
                    raise
        raise RuntimeError(f"{self.folder} changes faster than it can be read")

    def claim(self, number: int, record: dict) -> bool:
        """Puts a whole snapshot under its number, unless there is one: a link locally, elsewhere a rename that overwrites nothing."""
        whole, wanted = self.path(f"part-{uuid.uuid4().hex}"), self.path(f"snapshot-{number:09d}.json")
        stream = self.fs.create(whole, True)
        try:
            stream.write(json.dumps(record, sort_keys=True).encode())
        finally:
            stream.close()
        try:
            if self.local:
                os.link(whole.toUri().getPath(), wanted.toUri().getPath())
                return True
            kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.gateway.new_array(kind, 1)
            options[0] = kind.NONE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf).rename(whole, wanted, options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(whole, False)

    def compact(self, keep: int = KEEP) -> None:
        for number in self.numbers()[:-keep]:
            self.fs.delete(self.path(f"snapshot-{number:09d}.json"), False)


def update(spark: SparkSession, path: str, run_id: str, change: Callable[[dict], dict]) -> int:
    """The number of the snapshot that holds `change` of the latest record."""
    store = Store(spark, path, run_id)
    for _ in range(ATTEMPTS):
        number, record = store.latest()
        if store.claim(number + 1, change(record)):
            store.compact()
            return number + 1
    raise RuntimeError(f"no number could be had in {ATTEMPTS} attempts")


def merge_stage(record: dict, stage: str, payload: dict, at: str) -> dict:
    """A record with one stage set; other stages stay."""
    return {**record, "updated": at, "stages": {**record.get("stages", {}), stage: {"at": at, "payload": payload}}}


def record_stage(spark: SparkSession, path: str, run_id: str, stage: str, payload: dict, at: str) -> int:
    """Sets what a stage of a run says; a later write of the stage takes its place, whatever its time says."""
    return update(spark, path, run_id, lambda record: merge_stage(record, stage, payload, at))


def run_records(spark: SparkSession, path: str, run_ids: Iterable[str]) -> DataFrame:
    """run_id, stage, at, payload (JSON) of the stages of the named runs."""
    rows = []
    for run_id in run_ids:
        for stage, entry in Store(spark, path, run_id).latest()[1].get("stages", {}).items():
            rows.append((run_id, stage, entry["at"], json.dumps(entry["payload"], sort_keys=True)))
    return spark.createDataFrame(rows, _SCHEMA)


def run_record(spark: SparkSession, path: str) -> DataFrame:
    """The same of every run below the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())  # noqa: SLF001
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()] if fs.exists(folder) else []
    return run_records(spark, path, sorted(names))
