"""Published runs and shared searches in a folder that all drivers see: what is read is whole, what is claimed is claimed once.

A run's tables are written under a name of their own; then one manifest with each table's place, rows and digest is put in
place by a rename. Readers see manifests alone, so a run that was killed while it wrote is never read, whichever table it
came to. A run has one manifest: a second one is an error.

A search's trials are claimed by creating a file that must not exist yet. A claim is a lease: once it has run out and
there is no result, the next attempt's file may be created, again by one driver alone. Results are put in place by a rename.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.tables import latest_runs


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    place, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _at(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    place, system = _at(spark, path)
    system.mkdirs(place.getParent())
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if there is one. Of several drivers one alone gets True."""
    place, system = _at(spark, path)
    system.mkdirs(place.getParent())
    try:
        if system.getScheme() == "file":  # the file system's own exclusive creation
            files = spark.sparkContext._jvm.java.nio.file
            files.Files.createFile(files.Paths.get(system.makeQualified(place).toUri()), spark.sparkContext._gateway.new_array(files.attribute.FileAttribute, 0))
        else:
            system.create(place, False).close()
    except Py4JJavaError as error:
        if _taken(error):
            return False
        raise
    return True


def _taken(error: Py4JJavaError) -> bool:
    return error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException"


def put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there as a whole or not at all: written beside, then given its name. An existing one is an error."""
    beside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    _write(spark, beside, text)
    place, system = _at(spark, path)
    source = _at(spark, beside)[0]
    try:
        if system.getScheme() == "file":  # a local rename would replace the file; a second name for it doesn't
            files = spark.sparkContext._jvm.java.nio.file
            files.Files.createLink(*(files.Paths.get(system.makeQualified(p).toUri()) for p in (place, source)))
        elif system.exists(place) or not system.rename(source, place):
            raise FileExistsError(path)
    except Py4JJavaError as error:
        if _taken(error):
            raise FileExistsError(path) from None
        raise
    finally:
        system.delete(source, False)


# ---------------------------------------------------------------- published runs


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest of all of them: the sum of their hashes."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return row.n, str(row.s or 0)


def publish(spark: SparkSession, root: str, stage: str, model: str, run: str, tables: Mapping[str, DataFrame], facts: Mapping[str, Any]) -> str:
    """Writes a run's tables and then its manifest; returns the manifest's path."""
    manifest = f"{root}/manifests/{stage}/{model}/{run}.json"
    if exists(spark, manifest):
        raise FileExistsError(manifest)
    entries = {}
    for name, df in tables.items():
        place = f"{root}/tables/{uuid.uuid4().hex}/{name}"
        df.write.parquet(place)
        n, found = digest(spark.read.parquet(place))  # of what was written
        entries[name] = {"path": place, "rows": n, "digest": found}
    put(spark, manifest, json.dumps({"stage": stage, "model": model, "run": run, "tables": entries, "facts": dict(facts)}, sort_keys=True))
    return manifest


def manifests(spark: SparkSession, root: str) -> Iterator[dict]:
    """The manifests of all published runs; what has none isn't a run."""
    for stage in names(spark, f"{root}/manifests"):
        for model in names(spark, f"{root}/manifests/{stage}"):
            for name in names(spark, f"{root}/manifests/{stage}/{model}"):
                if name.endswith(".json") and not name.startswith("_"):
                    yield json.loads(read_text(spark, f"{root}/manifests/{stage}/{model}/{name}"))


def latest(spark: SparkSession, root: str, stages: tuple[str, ...]) -> dict[str, dict]:
    """Each model's manifest: its last run of the first of ``stages`` that has one."""
    found = {(m["model"], m["stage"], m["run"]): m for m in manifests(spark, root)}
    if not found:
        return {}
    rows = spark.createDataFrame([*found], "model string, stage string, run string")
    return {r.model: found[r.model, r.stage, r.run] for r in latest_runs(rows, stages).collect()}  # a row for each model


def read(spark: SparkSession, manifest: Mapping[str, Any], name: str, check: bool = True) -> DataFrame:
    """A published table; an error if its rows aren't those of the manifest any more."""
    entry = manifest["tables"][name]
    df = spark.read.parquet(entry["path"])
    if check and digest(df) != (entry["rows"], entry["digest"]):
        raise ValueError(f"{name} of {manifest['run']} isn't what was published")
    return df


# ---------------------------------------------------------------- shared searches


class Study:
    """A search that several drivers work on at once. ``clock`` gives seconds that all of them agree on roughly."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 3600.0, clock=time.time):
        self.spark, self.root, self.lease, self.clock = spark, root, lease, clock

    def results(self) -> list[dict]:
        """Finished trials by number; none where nothing is stored yet. A folder that can't be read is an error."""
        found = [json.loads(read_text(self.spark, f"{self.root}/results/{n}")) for n in names(self.spark, f"{self.root}/results") if not n.startswith("_")]
        return sorted(found, key=lambda t: t["trial"])

    def _claims(self) -> dict[int, tuple[int, float]]:
        """By trial its last attempt and when that runs out; the file's name says both."""
        out: dict[int, tuple[int, float]] = {}
        for name in names(self.spark, f"{self.root}/claims"):
            trial, attempt = map(int, name.split("-"))
            until = float(read_text(self.spark, f"{self.root}/leases/{name}")) if exists(self.spark, f"{self.root}/leases/{name}") else None
            if until is None:  # claimed a moment ago, or by a driver that died at once: it counts from the file's own time
                place, system = _at(self.spark, f"{self.root}/claims/{name}")
                until = system.getFileStatus(place).getModificationTime() / 1000 + self.lease
            out[trial] = max(out.get(trial, (-1, 0.0)), (attempt, until))
        return out

    def claim(self, most: int) -> int | None:
        """The least trial under ``most`` without a result or a lease that holds; None if there is none. Each goes to one driver."""
        while True:
            done, claims, now = {t["trial"] for t in self.results()}, self._claims(), self.clock()
            free = [k for k in range(most) if k not in done and (k not in claims or claims[k][1] <= now)]
            if not free:
                return None
            for k in free:
                name = f"{k}-{claims[k][0] + 1 if k in claims else 0}"
                if create_new(self.spark, f"{self.root}/claims/{name}"):
                    _write(self.spark, f"{self.root}/leases/{name}", repr(now + self.lease))
                    return k

    def finish(self, trial: int, score: float | None, params: Mapping[str, Any], steps: list[float] = []) -> bool:  # noqa: B006
        """Stores a trial's result; False if another attempt has stored one."""
        try:
            put(self.spark, f"{self.root}/results/{trial}.json", json.dumps({"trial": trial, "score": score, "params": dict(params), "steps": list(steps)}, sort_keys=True))
        except FileExistsError:
            return False
        return True
