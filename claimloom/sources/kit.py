"""A kit's enumeration as a data source: ``spark.read.format("kit")`` with level, place and seek as options.

Options: ``workspace`` (a folder of Parquet files, any URI that ``pyarrow.fs`` knows), ``level`` (``source_files`` or
``facts``), ``at`` (the file whose facts are asked for), ``cid`` (what the caller believes the file's content to be) and
``seek`` with ``ordinal`` (one fact).  Every row is a node, or a gap with its reason: a missing or unreadable file, a file outside the
workspace, a place left out, a content id that is out of date.  An unknown level and a seek at a level that has none are
refused by name, and never answered with a whole scan.

Files, and row groups of a file, are partitions; filters on ``ordinal`` and ``file`` are pushed down, so row groups and files that
they exclude are not read.  A file is read in batches and hashed in blocks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "kind string, file string, ordinal long, cid string, payload string, reason string"
LEVELS = ("source_files", "facts")
_BLOCK = 1 << 20


class Refused(ValueError):
    """A request that has no answer."""


@dataclass
class _Part(InputPartition):
    file: str
    group: int = -1
    first: int = 0
    rows: int = 0
    gap: str = ""


def _digest(files, path: str) -> tuple[str, int]:
    h, size = hashlib.sha256(), 0
    with files.open_input_stream(path) as f:
        while block := f.read(_BLOCK):
            h.update(block)
            size += len(block)
    return h.hexdigest(), size


def _row(kind: str, file: str, ordinal, cid, payload, reason) -> tuple:
    return (kind, file, ordinal, cid, payload, reason)


class KitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}
        self.level, self.at, self.seek = self.o.get("level", ""), self.o.get("at"), self.o.get("seek", "false").lower() == "true"
        if self.level not in LEVELS:
            raise Refused(f"level {self.level!r} is not served; levels are {', '.join(LEVELS)}")
        if self.seek and self.level != "facts":
            raise Refused(f"seek at level {self.level!r} is not answered; the one seek is at level 'facts'")
        if self.seek and "ordinal" not in self.o:
            raise Refused("a seek names its ordinal")
        if "workspace" not in self.o:
            raise Refused("a request names its workspace")
        self.low, self.high, self.file, self.bounded = 0, (1 << 63) - 1, None, False
        if self.seek:
            self.low = self.high = int(self.o["ordinal"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ``ordinal`` with a number and equality of ``file``; the rest is Spark's."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "ordinal" and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
                self.bounded = True
            elif name == "file" and isinstance(f, EqualTo) and isinstance(value, str) and self.file in (None, value):
                self.file = value
            else:
                yield f

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.o["workspace"].rstrip("/"))

    def partitions(self) -> list[_Part]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        files, root = self._files()
        if self.level == "source_files":
            found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            names = sorted(i.base_name for i in found if i.type == fs.FileType.File and i.base_name.endswith(".parquet"))
            return [_Part(n) for n in names if self.file in (None, n)]
        if not self.at:
            return [_Part("", gap="no-file-named")]
        if self.file not in (None, self.at):
            return []
        if "/" in self.at or self.at in ("..", "."):
            return [_Part(self.at, gap="outside-workspace")]
        path = f"{root}/{self.at}"
        if files.get_file_info(path).type != fs.FileType.File:
            return [_Part(self.at, gap="missing-file")]
        if "cid" in self.o and self.o["cid"] != _digest(files, path)[0]:
            return [_Part(self.at, gap="stale-cid")]
        try:
            with files.open_input_file(path) as f:
                meta = pq.read_metadata(f)
        except Exception:  # whatever a broken file makes of its footer, it is a gap
            return [_Part(self.at, gap="unreadable")]
        out, first = [], 0
        for g in range(meta.num_row_groups):
            n = meta.row_group(g).num_rows
            if first <= self.high and first + n > self.low:
                out.append(_Part(self.at, g, first, n))
            first += n
        return out

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        from pyarrow import parquet as pq

        if partition is None:  # no file, or none that the filters leave
            return
        if partition.gap:
            if not self.bounded:  # a gap has no ordinal
                yield _row("gap", partition.file, None, None, None, partition.gap)
            return
        files, root = self._files()
        path = f"{root}/{partition.file}"
        if partition.group < 0:
            if not self.bounded:
                cid, size = _digest(files, path)
                yield _row("node", partition.file, None, cid, json.dumps({"bytes": size}), None)
            return
        at = partition.first
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(4096, row_groups=[partition.group]):
                lo, hi = max(0, self.low - at), min(len(batch), self.high - at + 1)
                if hi > lo:
                    for i, row in enumerate(batch.slice(lo, hi - lo).to_pylist(), at + lo):
                        payload = json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
                        yield _row("node", partition.file, i, hashlib.sha256(payload.encode()).hexdigest(), payload, None)
                at += len(batch)


class KitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KitReader:
        return KitReader(self.options)


def enumerated(spark: SparkSession, workspace: str, level: str, **options) -> DataFrame:
    """The rows of one request; registers the source, and lets Python sources take filters, in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KitSource)
    return spark.read.format("kit").options(workspace=workspace, level=level, **{k: str(v) for k, v in options.items()}).load()
