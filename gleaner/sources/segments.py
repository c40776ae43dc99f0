"""Tables that grow: immutable segments under a manifest of versions.

A writer puts its tables into a new segment folder, which nobody reads yet, and then commits a version: one small file
that lists the segments of the version. The file is written under another name and renamed, and a rename never
replaces a version that is already there; so a version is seen whole or not at all, and of two writers of one version
one loses and may try again on top of the other. A segment without a version that names it is invisible.

    <root>/segments/<name>/<table>/    Parquet, never changed
    <root>/versions/<number>.json      the segments of a version, its settings
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Segment:
    name: str
    n_chunks: int
    n_tokens: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: tuple[Segment, ...] = ()
    settings: dict = field(default_factory=dict)

    @property
    def n_chunks(self) -> int:
        return sum(s.n_chunks for s in self.segments)

    @property
    def n_tokens(self) -> int:
        return sum(s.n_tokens for s in self.segments)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path on it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(found)


def _names(spark: SparkSession, path: str) -> list[str]:
    system, folder = _at(spark, path)
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    names = (name.removesuffix(".json") for name in _names(spark, f"{root}/versions") if name.endswith(".json"))
    return sorted(int(name) for name in names if name.isdigit())


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, by default the last; version 0 is empty."""
    if number is None:
        number = max(version_numbers(spark, root), default=0)
    if number == 0:
        return Version()
    told = json.loads(spark.read.text(f"{root}/versions/{number:012d}.json", wholetext=True).first()[0])
    return Version(told["number"], tuple(Segment(**s) for s in told["segments"]), told["settings"])


def commit(spark: SparkSession, root: str, version: Version) -> bool:
    """Makes ``version`` visible; False where its number is already taken."""
    system, folder = _at(spark, f"{root}/versions")
    system.mkdirs(folder)
    _, waiting = _at(spark, f"{root}/versions/_{uuid.uuid4().hex}")
    _, target = _at(spark, f"{root}/versions/{version.number:012d}.json")
    out = system.create(waiting, False)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    java = spark._jvm.org.apache.hadoop.fs
    never_replace = spark.sparkContext._gateway.new_array(java.Options.Rename, 0)
    try:
        java.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(waiting, target, never_replace)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.toString():
            raise
        return False
    return True


def change(spark: SparkSession, root: str, build: Callable[[Version], Version | None]) -> Version:
    """Commits what ``build`` makes of the last version, and builds again where another writer was first.

    ``build`` returns None where there is nothing to change."""
    while True:
        base = read_version(spark, root)
        made = build(base)
        if made is None:
            return base
        if commit(spark, root, made):
            return made


def new_segment(root: str) -> tuple[str, str]:
    """Name and folder of a segment to be written."""
    name = uuid.uuid4().hex
    return name, f"{root}/segments/{name}"


def read_table(spark: SparkSession, root: str, version: Version, name: str, schema: str) -> DataFrame:
    """One table of all segments of a version."""
    # Segments are read one by one, as each may hold folders of its own; compaction keeps them few.
    tables = [spark.read.schema(schema).parquet(f"{root}/segments/{s.name}/{name}") for s in version.segments]
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema)


def unreferenced(spark: SparkSession, root: str) -> list[str]:
    """Segment folders that no version names: of writers that failed, lost, or still write. Deleting is left to the
    caller, who knows whether a writer is at work."""
    used = {s.name for n in version_numbers(spark, root) for s in read_version(spark, root, n).segments}
    return sorted(set(_names(spark, f"{root}/segments")) - used)
