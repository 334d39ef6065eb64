"""The scan as one plan, and the places where scanners and reasoners are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as fnd
from ..operators import graph, scan, symbols, taint
from ..operators.protocol import backfilled
from ..session import cut
from ..sources import code
from ..sources.tools import READERS

# Methods of the layers, and the ones asked for by framework.
METHODS = {
    1: ["core-ast-engine", "control-flow-engine", "dataflow-taint-engine", "async-flow-modeling", "module-callgraph-engine"],
    3: ["sanitizer-recognition-engine", "false-positive-reduction-engine", "business-logic-anomaly-engine", "architecture-trust-boundary-engine", "cross-service-token-acceptance-engine"],
}
FRAMEWORK_METHODS = {f: f"sast-{f}-security-engine" for f in ("django", "flask", "express", "nextjs")}


class Scanner(Protocol):
    """Anything that gives findings for files."""

    name: str

    def available(self) -> bool: ...

    def scan(self, files: DataFrame) -> DataFrame: ...


class Reasoner(Protocol):
    """Anything that answers prompts. It runs in Arrow batches on the executors; tests and replays answer from a table."""

    def answer(self, prompts: list[str]) -> list[str]: ...


@dataclass
class PatternScanner:
    name: str = "pattern_scanner"

    def available(self) -> bool:
        return True

    def scan(self, files: DataFrame) -> DataFrame:
        return scan.pattern_findings(files).drop("rule_id")


@dataclass
class CapturedReports:
    """A scanner whose JSON was captured: reports(json)."""

    name: str
    reports: DataFrame

    def available(self) -> bool:
        return self.name in READERS

    def scan(self, files: DataFrame) -> DataFrame:
        return READERS[self.name](self.reports)


@dataclass
class Registry:
    scanners: dict[str, Scanner] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def add(self, scanner: Scanner) -> Registry:
        self.scanners[scanner.name] = scanner
        return self

    def status(self) -> dict[str, bool]:
        return {n: s.available() for n, s in self.scanners.items()}

    def scan_all(self, files: DataFrame) -> DataFrame | None:
        """Bag union of the findings of all available scanners; one that raises while its plan is built is skipped and noted in `failed`."""
        parts = []
        for name, s in self.scanners.items():
            if s.available():
                try:
                    parts.append(s.scan(files))
                except Exception as e:  # noqa: BLE001
                    self.failed[name] = str(e)
        return fnd.merged(*parts) if parts else None


def reasoned(prompts: DataFrame, make: Callable[[], Reasoner], prompt: str = "prompt") -> DataFrame:
    """prompts with a column answer; make() builds the reasoner once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = make()
        for frame in frames:
            yield frame.assign(answer=r.answer(frame[prompt].tolist()))

    return prompts.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", answer string")


def framework_methods(stack: DataFrame) -> DataFrame:
    """framework, method of the frameworks in a tech stack row that have a method."""
    mapped = stack.sparkSession.createDataFrame(list(FRAMEWORK_METHODS.items()), "framework string, method string")
    return stack.select(F.explode("frameworks").alias("framework")).join(mapped, "framework")


@dataclass
class Scan:
    files: DataFrame
    functions: DataFrame
    edges: DataFrame
    flows: DataFrame
    findings: DataFrame


def full_scan(files: DataFrame, registry: Registry | None = None) -> Scan:
    """files(path, content) to symbols, call graph, taint flows and filtered findings.

    Functions and edges are cut once, since every level of the walks behind `flows` reads them: sources are parsed a single time. The walks
    run while the plan is built; findings are lazy.
    """
    inside = scan.selected(files)
    items = code.parsed(inside)
    items = cut(items)
    functions = cut(symbols.flagged(code.functions(items)))
    edges = cut(graph.call_edges(functions, graph.import_map(code.imports(items))))
    found = (registry or Registry().add(PatternScanner())).scan_all(inside)
    columns = [c for c in ("description", "remediation") if c not in found.columns]
    found = found.withColumns({c: F.lit("") for c in columns}).withColumns({"seq": F.xxhash64("source", "file_path", "line_number", "title"), "is_false_positive": F.lit(False), "false_positive_reason": F.lit(None).cast("string")})
    return Scan(inside, functions, edges, taint.flows(edges, functions), fnd.rule_filtered(backfilled(found)))
