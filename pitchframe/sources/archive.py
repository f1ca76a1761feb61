"""A Spark data source for ZIP archives of nested match records, one JSON member for each match, read without unpacking.

``spark.dataSource.register(MatchArchive)``, then ``spark.read.format("match_archive").load(path)``: a row for each member named
``<digits>.json``, with match_id, the fields of ``MATCH_JSON``, member, and problem. ``path`` is an archive, several parted by commas, or a folder
of them, on any store that Arrow knows by its address. An archive's partitions are ranges of its members of about ``rangeBytes`` each (packed
size; 16 MB unless set), so a large archive is read by many tasks. A schema given to the reader prunes: only its columns, and only its nested
fields, leave the task.

Defined results: other members are passed over; a member that cannot be unpacked, is no JSON object, or does not fit the schema is a row with
its match_id, its name and its problem, all else null; an archive without records has no rows; a file that is no archive is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .ingest import MATCH_JSON

RANGE_BYTES = 16 << 20
TOGETHER = 64  #: members of a batch


@dataclass
class Members(InputPartition):
    """Members ``first`` to ``last`` (not included) of an archive's records, in the order of its directory."""

    archive: str
    first: int
    last: int


def _opened(path: str):
    """The archive's file, on whatever store it is."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def archives(path: str) -> list[str]:
    from pyarrow import fs

    found = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        store, at = _opened(one)
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            inside = store.get_file_info(fs.FileSelector(at))
            found += [f"{one.rstrip('/')}/{f.base_name}" for f in sorted(inside, key=lambda f: f.base_name) if f.base_name.endswith(".zip")]
        else:
            found.append(one)
    return found


def records(file) -> list:
    """The directory entries of the archive's match records."""
    return [m for m in file.infolist() if m.filename.endswith(".json") and m.filename[:-5].isascii() and m.filename[:-5].isdigit()]


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, range_bytes: int):
        self.schema, self.path, self.range_bytes = schema, path, range_bytes

    def partitions(self) -> list[Members]:
        import zipfile

        out = []
        for path in archives(self.path):
            store, at = _opened(path)
            with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as file:
                sizes = [m.compress_size for m in records(file)]
            first = size = 0
            for i, n in enumerate(sizes):
                if size and size + n > self.range_bytes:
                    out.append(Members(path, first, i))
                    first, size = i, 0
                size += n
            if sizes:
                out.append(Members(path, first, len(sizes)))
        return out or [Members("", 0, 0)]

    def read(self, part: Members) -> Iterator:
        import json
        import zipfile

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.archive:
            return
        schema = to_arrow_schema(self.schema)
        wanted = [f for f in schema if f.name not in ("match_id", "member", "problem")]
        store, at = _opened(part.archive)
        with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as file:
            chosen = records(file)[part.first : part.last]
            for lo in range(0, len(chosen), TOGETHER):
                rows = []
                for member in chosen[lo : lo + TOGETHER]:
                    row = {"match_id": int(member.filename[:-5]), "member": member.filename}
                    try:
                        if wanted:
                            found = json.loads(file.read(member))
                            fields = {f.name: _fitting(found.get(f.name), f.type) for f in wanted}
                            pa.RecordBatch.from_pylist([fields], pa.schema(wanted))  # whether it fits
                            row |= fields
                    except Exception as e:  # a broken member is a row of its own
                        row["problem"] = f"{type(e).__name__}: {e}"[:200]
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)


def _fitting(value, kind):
    """``value`` with numbers as text where the schema wants text, as seasons are written both ways; an error if objects or lists differ."""
    import pyarrow.types as pt

    if value is not None and (pt.is_struct(kind) != isinstance(value, dict) or pt.is_list(kind) != isinstance(value, list)):
        raise TypeError(f"{kind} wanted, not {type(value).__name__}")
    if isinstance(value, dict):
        return {f.name: _fitting(value[f.name], f.type) for f in kind if f.name in value}
    if isinstance(value, list):
        return [_fitting(v, kind.value_type) for v in value]
    if pt.is_string(kind) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value)
    return value


class MatchArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_archive"

    def schema(self) -> str:
        return f"match_id bigint, {MATCH_JSON}, member string, problem string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def readable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("problem").isNull()).drop("problem", "member")


def rejects(rows: DataFrame) -> DataFrame:
    """member and problem of the members that could not be read."""
    return rows.where(F.col("problem").isNotNull()).select("match_id", "member", "problem")
