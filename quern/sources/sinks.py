"""Writing: corpora that are never overwritten, atomic documents, staged folders and reports without content."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

#: Columns that hold sample content and never leave in a report.
CONTENT = frozenset(("text", "prompt", "content", "rendered", "messages", "html", "code"))


def write_corpus(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A Parquet corpus; an existing one is an error. Order is a column, files are sorted by it within."""
    (rows.sortWithinPartitions(*order) if order else rows).write.mode("errorifexists").parquet(path)


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Append samples to a tab-separated series."""
    rows.write.mode("append").option("sep", "\t").csv(path)


def manifest(summary: DataFrame, **facts) -> dict:
    """A manifest of a bounded summary, one entry a source, with totals."""
    sources = [r.asDict(recursive=True) for r in summary.orderBy(*summary.columns[:1]).collect()]
    return {**facts, "rows": sum(s.get("n_rows", 0) for s in sources), "total_tokens": sum(s.get("tokens", 0) for s in sources), "sources": sources}


def atomic_json(path: str, payload: dict, mode: int = 0o600) -> None:
    """Sorted keys, NaN refused; the document appears whole under its name or not at all."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(payload, file, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False)
            file.write("\n")
            file.flush()
            os.fsync(file.fileno())
        os.chmod(name, mode)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


class Staged:
    """A folder that appears under its name only when its work ends well; an existing one is an error."""

    def __init__(self, path: str) -> None:
        self.target = Path(path)
        self.folder = self.target.parent / f".{self.target.name}.tmp"

    def __enter__(self) -> Path:
        if self.target.exists():
            raise FileExistsError(self.target)
        self.folder.mkdir(parents=True)
        return self.folder

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.folder.rename(self.target)


def content_free(report: DataFrame) -> DataFrame:
    """The report, if no column holds content; else an error."""
    found = sorted(CONTENT & {c.lower() for c in report.columns})
    if found:
        raise ValueError(f"a report may not hold {found}")
    return report


def markdown_table(report: DataFrame, signed: tuple[str, ...] = ()) -> str:
    """A bounded report as a Markdown table: six decimals, a dash where missing, a sign on deltas."""

    def show(name: str, value) -> str:
        if value is None:
            return "—"
        if isinstance(value, float):
            return f"{value:+.6f}" if name in signed else f"{value:.6f}"
        return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)

    columns = content_free(report).columns
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(show(c, r[c]) for c in columns) + " |" for r in report.collect()]
    return "\n".join(lines) + "\n"
