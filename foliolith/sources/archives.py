"""A Spark data source for plot project archives (USTAR files): reader and writer, standard library only."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Limits of an archive. Fixed values.
MOST_BYTES, MOST_FILES = 100_000_000, 50
#: Version that info.json states. Fixed value.
VERSION = [4, 0]
SCHEMA = "path string, name string, info string, project string, image binary, error string"


class ArchiveError(ValueError):
    """An archive that is not taken."""


def read_archive(data: bytes) -> dict:
    """Members of a project archive: one info.json that names a version 4 project JSON, and an image.

    Links, names that are absolute, lead upwards or hold backslashes, repeated names, more than MOST_FILES members, members
    or totals beyond MOST_BYTES, and references outside the archive's folder are refused.
    """
    try:
        tar = tarfile.open(fileobj=io.BytesIO(data), mode="r:")
        members = [m for m in tar.getmembers() if not m.isdir()]
    except tarfile.TarError as wrong:
        raise ArchiveError(f"not an archive: {wrong}") from None
    paths = {m.name: PurePosixPath(m.name) for m in members}
    infos = [n for n, p in paths.items() if p.name == "info.json"]
    _refuse(
        {
            "a member that is no plain file": any(not m.isfile() for m in members),
            "a name that leads out of the archive": any(p.is_absolute() or {"..", "\\"} & {*p.parts, *n} for n, p in paths.items()),
            "a name that repeats": len(paths) < len(members),
            "too many members": len(members) > MOST_FILES,
            "too many bytes": sum(m.size for m in members) > MOST_BYTES,
            "not exactly one info.json": len(infos) != 1,
        }
    )
    content = {m.name: tar.extractfile(m).read() for m in members}
    folder = paths[infos[0]].parent
    try:
        info = json.loads(content[infos[0]])
        named = [info["json"], *info["images"]]
    except (ValueError, KeyError, TypeError) as wrong:
        raise ArchiveError(f"info.json: {wrong}") from None
    _refuse(
        {
            "another version": info.get("version") != VERSION,
            "not one project with one image": len(named) != 2 or not all(isinstance(n, str) for n in named),
            "a reference to what isn't beside info.json": any(not isinstance(n, str) or "/" in n or str(folder / n) not in content for n in named),
        }
    )
    project, image = (content[str(folder / n)] for n in named)
    return {"info": content[infos[0]].decode(), "project": project.decode(), "image": image}


def _refuse(faults: dict[str, bool]) -> None:
    """Raise what is wrong, all of it."""
    if wrong := [name for name, there in faults.items() if there]:
        raise ArchiveError("; ".join(wrong))


def write_archive(name: str, project: str, image: bytes) -> bytes:
    """Bytes of a project archive; equal input gives equal bytes."""
    info = json.dumps({"version": VERSION, "json": "wpd.json", "images": ["image.png"]}).encode()
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for member, data in (("info.json", info), ("wpd.json", project.encode()), ("image.png", image)):
            header = tarfile.TarInfo(f"{name}/{member}")
            header.size = len(data)
            tar.addfile(header, io.BytesIO(data))
    return out.getvalue()


def readable(data: bytes) -> bool:
    """Whether the bytes are an archive that can be listed."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            tar.getmembers()
        return True
    except (tarfile.TarError, EOFError, OSError):
        return False


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, files: int) -> None:
        self.folder, self.files = folder, files

    def partitions(self) -> list[InputPartition]:
        paths = sorted(str(p) for p in Path(self.folder).rglob("*.tar"))
        return [_Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            name = Path(path).stem
            try:
                if os.path.getsize(path) > MOST_BYTES + (1 << 20):
                    raise ArchiveError("too many bytes")
                found = read_archive(Path(path).read_bytes())
                yield path, name, found["info"], found["project"], found["image"], None
            except (ArchiveError, OSError) as wrong:
                yield path, name, None, None, None, str(wrong)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    """Each task writes under a staging name; only the commit gives files their own names."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        Path(self.folder).mkdir(parents=True, exist_ok=True)
        task = TaskContext.get()
        paths = []
        for row in rows:
            if PurePosixPath(row["name"]).name != row["name"] or "\\" in row["name"] or row["name"] in (".", ".."):
                raise ArchiveError(f"{row['name']!r} is no file name")
            path = f"{self.folder}/.{row['name']}.tar.{task.taskAttemptId() if task else 0}"
            Path(path).write_bytes(write_archive(row["name"], row["project"], bytes(row["image"] or b"")))
            paths.append(path)
        return _Written(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                os.replace(path, path.rpartition(".")[0].replace("/.", "/"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                Path(path).unlink(missing_ok=True)


class PlotArchives(DataSource):
    """`spark.read.format("plot_archives").load(folder)`; writes rows (name, project, image) to `folder`."""

    @classmethod
    def name(cls) -> str:
        return "plot_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("filesPerPartition", 64)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(PlotArchives)
