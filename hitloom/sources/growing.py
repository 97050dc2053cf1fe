"""Log files as a data source with exact byte positions: whole ones in a batch, growing ones as a stream.

Spark's own text stream reads a file once, when it appears.  Logs grow, and are rotated: renamed,
or emptied in place.  Here the offset of a stream says for each file how many bytes of it are read.
A file is known by its inode and the check sum of its first line, so it goes on where it was when it has a new
name, and starts anew when another file has taken its name or its inode, or when it was emptied.

Only whole lines are read; one without its end waits.  Long stretches are dealt out like the splits of
any file.  ``byte``, the position of a line in its file, orders lines, however the file was split.

The files must lie in a folder that the driver and all executors have mounted.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "site_id int, file string, path string, byte bigint, line string"
SPLIT_BYTES = 64 << 20
#: Splits that a batch is cut into at most, while they are below ``SPLIT_BYTES``: small splits of large files would
#: each cost a task.
MOST_SPLITS = 512
BLOCK = 1 << 20
#: Bytes of the first line that name a file.
HEAD = 4096


def mounted(path: str) -> str:
    """The path without its scheme; stores that cannot be mounted are refused."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path}: growing files need a mounted folder; read arriving files of a store with stream_new_files")
    return "/" + rest.lstrip("/")


def listed(pattern: str) -> list[str]:
    """The files that a pattern names, those of a folder one by one; hidden ones and markers left out."""
    found = glob.glob(mounted(pattern), recursive=True)
    files = [f for p in found for f in (glob.glob(f"{glob.escape(p)}/*") if os.path.isdir(p) else [p])]
    return sorted({f for f in files if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_"))})


def identity(path: str) -> str | None:
    """Inode and check sum of the first line; None until that line is whole."""
    with open(path, "rb") as file:
        at, head = os.fstat(file.fileno()), file.readline(HEAD)
    if len(head) < HEAD and not head.endswith(b"\n"):
        return None
    return f"{at.st_dev:x}-{at.st_ino:x}-{zlib.crc32(head):08x}"


def whole_lines(path: str) -> int:
    """Bytes up to the end of the last whole line."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - BLOCK)
            file.seek(start)
            last = file.read(end - start).rfind(b"\n")
            if last >= 0:
                return start + last + 1
            end = start
    return 0


@dataclass
class Stretch(InputPartition):
    """The lines that start within [start, end) of a file; ``first`` if a line starts at ``start``."""

    site: int
    file: str
    path: str
    start: int
    end: int
    first: bool
    search: tuple[str, ...] = ()


def stretches(site: int, file: str, path: str, start: int, end: int, split: int, search: tuple[str, ...] = ()) -> list[Stretch]:
    cuts = [*range(start, end, split), end]
    return [Stretch(site, file, path, a, b, a == start, search) for a, b in zip(cuts, cuts[1:])]


def split_bytes(asked: int, total: int) -> int:
    """Bytes of a split, those asked for or more: so many that ``total`` is ``MOST_SPLITS`` splits, or ``SPLIT_BYTES``."""
    return max(asked, min(SPLIT_BYTES, -(-total // MOST_SPLITS)))


def positions(file, start: int, end: int, first: bool) -> Iterator[tuple[list[bytes], list[int]]]:
    """Blocks of lines and the positions of their first bytes."""
    at = start if first else start - 1
    file.seek(at)
    if not first:
        while True:  # the line that holds the byte before is another stretch's
            part = file.readline(BLOCK)
            at += len(part)
            if not part or part.endswith(b"\n"):
                break
    rest = b""
    while at < end:
        block = file.read(BLOCK)
        if not block and not rest:
            return
        data = rest + block
        lines = data.split(b"\n")
        rest = lines.pop() if block else b""
        places = []
        for line in lines:
            if at >= end:
                break
            places.append(at)
            at += len(line) + 1
        if places:
            yield lines[: len(places)], places
        if not block:
            return


def found_again(part: Stretch) -> str:
    """Where the file of a stretch is now: it may have been renamed since it was listed."""
    for path in [part.path, *(f for pattern in part.search for f in listed(pattern))]:
        try:
            if not part.search or identity(path) == part.file:
                return path
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"{part.path} was read up to byte {part.start} and is gone with what it had up to {part.end}")


def read_stretch(part: Stretch) -> Iterator[pa.RecordBatch]:
    options = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
    with (gzip.open if part.path.endswith(".gz") else open)(found_again(part), "rb") as file:
        for lines, places in positions(file, part.start, part.end, part.first):
            kept = [(x.removesuffix(b"\r"), p) for x, p in zip(lines, places) if x not in (b"", b"\r")]
            n = len(kept)
            texts = pc.cast(pa.array([x for x, _ in kept], pa.binary()), options=options)
            columns = [pa.array([part.site] * n, pa.int32()), pa.array([part.file] * n), pa.array([part.path] * n), pa.array([p for _, p in kept], pa.int64()), texts]
            yield pa.RecordBatch.from_arrays(columns, names=["site_id", "file", "path", "byte", "line"])


class _Options:
    def __init__(self, options: dict[str, str]):
        self.sites = [(int(s), p) for s, p in json.loads(options["sites"])]
        self.split = int(options.get("split", SPLIT_BYTES))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(partition)


class WholeFiles(_Options, DataSourceReader):
    """All lines of the files there are, the last one too if it has no end.  Packed files are not split."""

    def partitions(self) -> list[Stretch]:
        out, sizes = [], {}
        for site, pattern in self.sites:
            for path in listed(pattern):
                if path.endswith(".gz"):
                    out += [Stretch(site, identity(path) or path, path, 0, 1 << 62, True)]
                elif size := os.path.getsize(path):
                    sizes[site, path] = size
        split = split_bytes(self.split, sum(sizes.values()))
        for (site, path), size in sizes.items():
            out += stretches(site, identity(path) or path, path, 0, size, split)
        return out or [Stretch(0, "", os.devnull, 0, 0, True)]


class GrowingFiles(_Options, DataSourceStreamReader):
    """Offsets: {"files": {site and file: [path, bytes read]}}.  Files that are gone leave the offset."""

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for site, pattern in self.sites:
            for path in listed(pattern):
                if path.endswith(".gz"):
                    continue  # packed files do not grow, and what they hold was read before
                try:
                    if name := identity(path):
                        files[f"{site} {name}"] = [path, whole_lines(path)]
                except FileNotFoundError:
                    continue  # renamed since it was listed: the next offset has it
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        fresh = []
        for key, (path, stop) in end["files"].items():
            site, name = key.split(" ", 1)
            begun = start["files"].get(key, ["", 0])[1]
            begun = 0 if begun > stop else begun  # emptied in place and begun with the same line
            if begun < stop:
                fresh.append((int(site), name, path, begun, stop))
        split = split_bytes(self.split, sum(f[4] - f[3] for f in fresh))
        return [part for f in fresh for part in stretches(*f, split, tuple(p for s, p in self.sites if s == f[0]))]

    def commit(self, end: dict) -> None:
        pass


class LogFiles(DataSource):
    """Format ``logfiles``; option ``sites``: JSON list of [site, path or pattern]."""

    @classmethod
    def name(cls) -> str:
        return "logfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WholeFiles(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingFiles(self.options)


def ordinal(file, byte):
    """Orders lines of a file by their place, and files by their names' hashes, in one number: 23 bits of
    the file and 40 of the byte."""
    return F.shiftleft(F.xxhash64(file).bitwiseAND((1 << 23) - 1), 40) + byte


def _options(reader, sites: dict[int, str] | str, split: int):
    pairs = [(1, sites)] if isinstance(sites, str) else list(sites.items())
    return reader.format("logfiles").option("sites", json.dumps(pairs)).option("split", str(split))


def read_log_files(spark: SparkSession, sites: dict[int, str] | str, split: int = SPLIT_BYTES) -> DataFrame:
    """(site_id, rid, file, path, byte, line) of whole files, packed ones too; ``sites`` says which
    files are whose.  ``rid`` and ``byte`` are the same however files are split."""
    spark.dataSource.register(LogFiles)
    return _options(spark.read, sites, split).load().withColumn("rid", ordinal("file", F.col("byte")))


def stream_log_files(spark: SparkSession, sites: dict[int, str] | str, split: int = SPLIT_BYTES) -> DataFrame:
    """The same of growing files, as a stream."""
    spark.dataSource.register(LogFiles)
    return _options(spark.readStream, sites, split).load().withColumn("rid", ordinal("file", F.col("byte")))


#: A stretch of a file and its place in the file it is copied to.
COPIED = "target string, source string, begin bigint, size bigint, place bigint"


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for target, source, begin, size, place in zip(*(c.to_pylist() for c in batch.columns)):
            out = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                with open(source, "rb") as file:
                    file.seek(begin)
                    while size > 0:
                        block = file.read(min(BLOCK, size))
                        if not block:
                            raise EOFError(f"{source} is shorter than it was")
                        at = 0
                        while at < len(block):
                            at += os.pwrite(out, block[at:], place + at)
                        place, size = place + len(block), size - len(block)
            finally:
                os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])


def join_files(spark: SparkSession, joined: dict[str, list[str]]) -> None:
    """Appends files, in the order given, to each target, which is made if it is not there.

    Every stretch has its place in the target from the sizes alone, so many tasks write one file at once, each by
    a block at a time, and one that is repeated writes the same.
    """
    rows = []
    for target, sources in joined.items():
        place = os.path.getsize(target) if os.path.exists(target) else 0
        for source in sources:
            size = os.path.getsize(source)
            cuts = [*range(0, size, SPLIT_BYTES), size]
            rows += [(target, source, a, b - a, place + a) for a, b in zip(cuts, cuts[1:])]
            place += size
    if rows:
        tasks = min(len(rows), spark.sparkContext.defaultParallelism)
        spark.createDataFrame(rows, COPIED).repartition(tasks).mapInArrow(_copied, "n bigint").agg(F.sum("n")).collect()


def write_log_files(rows: DataFrame, folder: str, keys: tuple[str, ...] = ("site_id",), order: str = "rid", dealt: bool = False) -> dict[tuple[str, ...], list[str]]:
    """The ``line`` of each row in text files below ``folder``: for each value of the keys, the files in their order.

    Lines are dealt by ranges of keys and order, so a site of many lines is sorted in many tasks; its
    files, read one after another, have its lines by ``order``.  With ``dealt`` the rows come dealt so.
    """
    rows = rows if dealt else rows.repartitionByRange(*keys, order)
    sorted_rows = rows.sortWithinPartitions(*keys, order)
    sorted_rows.select(*keys, "line").write.partitionBy(*keys).text(folder)
    found: dict[tuple[str, ...], list[str]] = {}
    for path in listed(f"{folder}/" + "/".join(f"{k}=*" for k in keys) + "/*.txt"):
        values = path.split("/")[-len(keys) - 1 : -1]
        found.setdefault(tuple(v.split("=", 1)[1] for v in values), []).append(path)
    return {values: sorted(paths, key=os.path.basename) for values, paths in found.items()}
