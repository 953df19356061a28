"""Pipelines: steps that become one plan, and batches of files."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..operators.clean import Clean
from ..operators.dedupe import Dedupe
from ..operators.extract import Extract
from ..operators.filter import Filter, Rule
from ..operators.frame import LineFrame
from ..operators.sort import Sort
from ..sources.encoding import ANSI
from .runs import Result, run_steps

KINDS = {"clean": Clean, "filter": Filter, "dedupe": Dedupe, "extract": Extract, "sort": Sort}


@dataclass(frozen=True)
class Step:
    kind: str
    options: object | None = None
    enabled: bool = True

    def operator(self):
        if self.kind not in KINDS:
            raise ValueError(f"step: {self.kind}")
        if self.options is None:
            if self.kind in ("filter", "extract"):
                raise ValueError(f"a step of kind {self.kind} needs options")
            return KINDS[self.kind]()
        return self.options


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...] = field(default_factory=tuple)

    def operators(self) -> list:
        found = [s.operator() for s in self.steps if s.enabled]
        if not found:
            raise ValueError("no step is enabled")
        return found

    def apply(self, frame: LineFrame) -> LineFrame:
        for operator in self.operators():
            frame = operator.apply(frame)
        return frame

    def counts(self, frame: LineFrame) -> list[dict]:
        """input, output and affected lines of each step."""
        out = []
        for operator in self.operators():
            out.append(operator.counts(frame).first().asDict())
            frame = operator.apply(frame)
        return out

    def run(self, spark: SparkSession, source: str, target: str, fallback: str = ANSI) -> Result:
        """One file in, one new file out; the counters are those of the last step."""
        return run_steps(spark, self.operators(), source, target, fallback=fallback)

    def to_json(self) -> str:
        steps = [{"kind": s.kind, "enabled": s.enabled, "options": None if s.options is None else asdict(s.options)} for s in self.steps]
        return json.dumps({"name": self.name, "steps": steps}, ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        data, steps = json.loads(text), []
        for s in data["steps"]:
            options = s["options"]
            if options is not None:
                if s["kind"] == "filter":
                    options["rules"] = tuple(Rule(**r) for r in options["rules"])
                options = KINDS[s["kind"]](**options)
            steps.append(Step(s["kind"], options, s["enabled"]))
        return cls(data["name"], tuple(steps))


def clean_and_dedupe(clean: Clean | None = None, dedupe: Dedupe | None = None) -> Pipeline:
    return Pipeline("clean and dedupe", (Step("clean", clean or Clean()), Step("dedupe", dedupe or Dedupe())))


@dataclass(frozen=True)
class FileResult:
    source: str
    result: Result | None
    error: str | None = None
    cancelled: bool = False


class Batch:
    """A pipeline over many files, a few at a time, each with its own plan and outcome."""

    def __init__(self, pipeline: Pipeline, suffix: str = "_result", parallel: int = 2, tag: str = "lineloom-batch", fallback: str = ANSI):
        self.pipeline, self.suffix, self.parallel, self.tag, self.fallback = pipeline, suffix, min(8, max(1, parallel)), tag, fallback
        self._cancelled = False

    def cancel(self, spark: SparkSession) -> None:
        """Running files stop, and leave no output; those that wait do not begin."""
        self._cancelled = True
        spark.interruptTag(self.tag)

    def target(self, source: str, folder: str, base: str | None) -> str:
        """In ``folder``, under the path of the source below ``base`` if there is one."""
        below = source.removeprefix(base.rstrip("/") + "/").rpartition("/")[0] if base else ""
        stem, dot, ending = source.rpartition("/")[2].rpartition(".")
        name = f"{stem}{self.suffix}.{ending}" if dot else f"{ending}{self.suffix}"
        return "/".join(p for p in (folder.rstrip("/"), below, name) if p)

    def run(self, spark: SparkSession, sources: list[str], folder: str, base: str | None = None) -> list[FileResult]:
        """Results in the order of the sources."""

        def one(source: str) -> FileResult:
            if self._cancelled:
                return FileResult(source, None, cancelled=True)
            spark.addTag(self.tag)
            try:
                return FileResult(source, self.pipeline.run(spark, source, self.target(source, folder, base), self.fallback))
            except Exception as e:  # of one file; the others go on
                return FileResult(source, None, str(e), cancelled=self._cancelled)
            finally:
                spark.removeTag(self.tag)

        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(one, sources))
