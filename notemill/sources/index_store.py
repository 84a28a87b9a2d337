"""A saved vector index: whole snapshots, each with a manifest that makes it valid.

A snapshot is a folder of Parquet files. Its manifest is written last, beside it, and put
in its place by one rename; readers take the greatest manifest, so a snapshot is there as
a whole or not at all, and a run that fails leaves the one before it in force. The
manifest says how many documents, of which dimension, in how many files the snapshot has,
and up to which batch of a stream's log it goes; a reader that finds other numbers stops.
All files are reached through Spark's own file systems.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.operators import vectors

COLUMNS = ["document_id", "vector", "metadata", "ordinal"]


@dataclass(frozen=True)
class Manifest:
    version: int
    count: int
    dimension: int
    parts: int
    #: The last batch of a log that the snapshot holds; -1 without one.
    through: int = -1


def _files(spark: SparkSession, path: str):
    """(the file system of a path, the path as it knows it)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _snapshot(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version}"


def _parts(spark: SparkSession, folder: str) -> int:
    return sum(n.endswith(".parquet") for n in _names(spark, folder))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The manifest of a version, or of the greatest one; an error without any."""
    known = sorted(int(m[1]) for n in _names(spark, path) if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"there is no saved index {'' if version is None else f'of version {version} '}at {path}")
    text = spark.read.text(f"{path.rstrip('/')}/manifest-{known[-1] if version is None else version}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def saved(spark: SparkSession, path: str) -> bool:
    """Whether there is an index at a path."""
    return any(re.fullmatch(r"manifest-\d+\.json", n) for n in _names(spark, path))


def save(index: DataFrame, path: str, through: int = -1) -> Manifest:
    """Writes a snapshot of (document_id, vector, metadata, ordinal), and its manifest once all of it is there.

    The next version is one more than the greatest; a folder that a failed run has left
    there is written over. Vectors of different dimensions are an error.
    """
    spark = index.sparkSession
    try:
        version = manifest(spark, path).version + 1
    except FileNotFoundError:
        version = 1
    folder = _snapshot(path, version)
    index.select(*COLUMNS).write.mode("overwrite").parquet(folder)
    sizes = spark.read.parquet(folder).agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"the vectors have from {sizes['least']} to {sizes['most']} components")
    made = Manifest(version, sizes["n"], sizes["most"] or 0, _parts(spark, folder), through)
    files, place = _files(spark, f"{path.rstrip('/')}/manifest-{version}.json")
    open_place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_manifest-{version}.json")
    out = files.create(open_place, True)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    if not files.rename(open_place, place):
        raise FileExistsError(f"version {version} of {path} was written by another run")
    return made


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot; an error if it has not the files, documents or dimension that its manifest says."""
    said = manifest(spark, path, version)
    folder = _snapshot(path, said.version)
    if (parts := _parts(spark, folder)) != said.parts:
        raise ValueError(f"{folder} has {parts} files, its manifest says {said.parts}")
    index = spark.read.schema("document_id string, vector array<double>, metadata map<string,string>, ordinal long").parquet(folder)
    found = index.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if (found["n"], found["d"] or 0) != (said.count, said.dimension):
        raise ValueError(f"{folder} has {found['n']} vectors of dimension {found['d']}, its manifest says {said.count} of {said.dimension}")
    return index


def changed(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose vector (at length 1) or metadata the index does not hold already."""
    state = lambda vector: F.xxhash64(F.transform(vector, lambda x: F.round(x, 9)), F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))))
    held = index.select("document_id", state(F.col("vector")).alias("state"))
    return rows.withColumn("state", state(vectors.unit(F.col("vector")))).join(held, ["document_id", "state"], "left_anti").select(*COLUMNS)


def update(spark: SparkSession, path: str, rows: DataFrame, dimension: int, removed: DataFrame | None = None) -> Manifest:
    """Puts rows into the saved index and takes removed ones out; without any change the version stays."""
    try:
        said, index = manifest(spark, path), load(spark, path)
    except FileNotFoundError:
        said, index = None, spark.createDataFrame([], "document_id string, vector array<double>, metadata map<string,string>, ordinal long")
    fresh = changed(index, rows)
    kept = index if removed is None else vectors.remove(index, removed)
    if said is not None and fresh.isEmpty() and (removed is None or kept.count() == said.count):
        return said
    return save(vectors.upsert(vectors.remove(kept, fresh), fresh, dimension), path, -1 if said is None else said.through)


def compact(spark: SparkSession, log: str, path: str) -> Manifest:
    """Takes the batches of a log (see streaming.index.follow) that the saved index does not hold yet into a new snapshot.

    The manifest says how far it goes, so a batch is taken in once, however often this
    runs and wherever it stopped; batches that are held may be deleted.
    """
    try:
        said, index = manifest(spark, path), load(spark, path)
    except FileNotFoundError:
        said, index = None, None
    through = -1 if said is None else said.through
    batches = sorted(int(m[1]) for n in _names(spark, log) if (m := re.fullmatch(r"batch=(\d+)", n)) and int(m[1]) > through and "_SUCCESS" in _names(spark, f"{log}/{n}"))
    if not batches:
        if said is None:
            raise FileNotFoundError(f"there is no whole batch at {log}")
        return said
    rows = spark.read.option("basePath", log).parquet(*[f"{log}/batch={b}" for b in batches])
    newest = rows.groupBy("document_id").agg(F.max_by(F.struct("vector", "metadata", "ordinal"), "batch").alias("r")).select("document_id", "r.*")
    kept = newest if index is None else vectors.remove(index, newest).unionByName(newest)
    return save(kept, path, batches[-1])
