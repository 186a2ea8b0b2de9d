"""Snapshots: file statistics kept as Parquet tables, one folder each, with a small document of facts beside them.

A snapshot is never overwritten: its id is the time in nanoseconds, with a suffix if that id is taken.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallystone.operators.aggregate import FILE_STATS

VERSION = 1


@dataclass
class Snapshot:
    id: str
    timestamp: str
    label: str | None = None
    commit: str | None = None
    branch: str | None = None
    has_regions: bool = False
    duplication: bool = True
    version: int = VERSION


class SnapshotStore:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder).resolve()  # Spark and Python may have different working folders

    def save(self, files: DataFrame, regions: DataFrame | None = None, label: str | None = None, commit: str | None = None, branch: str | None = None, duplication: bool = True, now_ns: int | None = None) -> Snapshot:
        now = time.time_ns() if now_ns is None else now_ns
        at = datetime.fromtimestamp(now // 10**9, UTC)
        base = f"{at:%Y-%m-%dT%H-%M-%S}.{now % 10**9:09d}Z"
        self.folder.mkdir(parents=True, exist_ok=True)
        name, n = base, 0
        while True:
            try:
                Path(self.folder, name).mkdir()
                break
            except FileExistsError:
                n += 1
                name = f"{base}~{n}"
        snap = Snapshot(name, at.replace(microsecond=now % 10**9 // 1000).isoformat(), label, commit, branch, regions is not None, duplication)
        files.write.parquet(str(self.folder / name / "files"))
        if regions is not None:
            regions.write.parquet(str(self.folder / name / "regions"))
        (self.folder / name / "snapshot.json").write_text(json.dumps(asdict(snap)))
        return snap

    def list(self) -> list[Snapshot]:
        """All readable snapshots, the oldest first."""
        out = []
        for meta in self.folder.glob("*/snapshot.json"):
            try:
                found = json.loads(meta.read_text())
                out.append(Snapshot(**{k: v for k, v in found.items() if k in Snapshot.__dataclass_fields__}))
            except (ValueError, TypeError, OSError):
                continue
        return sorted(out, key=lambda s: (s.timestamp, s.id))

    def resolve(self, ref: str) -> Snapshot:
        """'latest', 'latest~N', an id or label, or the newest one of a date or its beginning."""
        found = self.list()
        if ref == "latest" or ref.startswith("latest~"):
            back = int(ref[7:] or 0) if ref != "latest" else 0
            if back < len(found):
                return found[-1 - back]
        for s in reversed(found):
            if ref in (s.id, s.label) or s.timestamp.startswith(ref):
                return s
        raise ValueError(f"no snapshot {ref!r}")

    def files(self, spark: SparkSession, snap: Snapshot) -> DataFrame:
        """The statistics under the schema of today: what an older snapshot lacks is null or not measured."""
        return spark.read.schema(FILE_STATS).parquet(str(self.folder / snap.id / "files"))

    def regions(self, spark: SparkSession, snap: Snapshot) -> DataFrame | None:
        return spark.read.parquet(str(self.folder / snap.id / "regions")) if snap.has_regions else None
