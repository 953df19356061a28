"""Settings, history and saved pipelines, as small JSON files that are replaced as a whole."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from datetime import date

from pyspark.sql import SparkSession

from .files import Files


@dataclass
class Settings:
    normal_bytes: int = 32 << 20
    preview_lines: int = 5_000
    index_interval: int = 10_000
    search_results: int = 10_000
    recent_files: int = 20
    parallel_files: int = 2


@dataclass
class History:
    """Lines processed by day, and files used, the latest first."""

    lines_by_day: dict[str, int] = field(default_factory=dict)
    recent: list[str] = field(default_factory=list)

    def add_lines(self, day: date, lines: int) -> None:
        self.lines_by_day[day.isoformat()] = self.lines_by_day.get(day.isoformat(), 0) + lines

    def add_file(self, path: str, most: int = 20) -> None:
        self.recent = [path, *(p for p in self.recent if p.lower() != path.lower())][:most]


def save(spark: SparkSession, path: str, value) -> None:
    with Files(spark).writing(path, overwrite=True) as write:
        write(json.dumps(value if isinstance(value, (dict, list)) else asdict(value), ensure_ascii=False, indent=1).encode())


def load(spark: SparkSession, path: str, kind):
    """The value saved; a new one if there is no file.  Unknown fields are left out."""
    files = Files(spark)
    if not files.exists(path):
        return kind()
    data = json.loads(files.read(path))
    if kind in (dict, list):
        return data
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in data.items() if k in known})
