"""Diagnostics: stable codes, severities and the shape of an issue."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("fatal", "error", "warning", "info", "hint")

# Codes by category.
CODES = {
    "sentinel": "E_LIMIT_REACHED E_INTERNAL",
    "syntax": "E_SYNTAX",
    "adapter": "E_ADAPTER_PARSE",
    "schema": "E_TYPE_COLLISION E_INHERIT_CYCLE E_SCHEMA_TYPE_NOT_FOUND E_UNKNOWN_PROPERTY E_DUPLICATE_PROPERTY E_DUPLICATE_RELATION E_CASE_COLLISION E_PROPERTY_RELATION_COLLISION E_RELATION_NORMALIZATION_COLLISION E_RESERVED_PREFIX E_INVALID_RELATION E_INVALID_ASSOCIATION_TARGET E_INVALID_COMPOSITION_TARGET E_INVALID_CONSTRAINT E_INVALID_INVARIANT E_INVALID_NAME E_UPSTREAM_FAIL E_PROPERTY_CONFLICT E_UNKNOWN_TYPE E_DUPLICATE_TYPE E_RELATION_COLLISION E_MISSING_SOURCE_ID E_INVALID_SYNTHETIC_ID E_LIST_ON_EDGE E_INVALID_PRIMARY_KEY_TYPE",
    "import": "E_IMPORT_RESOLVE E_IMPORT_CYCLE E_INVALID_ALIAS E_PATH_ESCAPE E_IMPORT_NOT_ALLOWED E_DUPLICATE_IMPORT E_IMPORT_ALIAS_COLLISION",
    "instance": "E_INSTANCE_TYPE_NOT_FOUND E_ABSTRACT_TYPE E_PART_TYPE_DIRECT E_TYPE_MISMATCH E_MISSING_REQUIRED E_MISSING_PRIMARY_KEY E_UNKNOWN_FIELD E_CONSTRAINT_FAIL E_INVARIANT_FAIL E_EVAL_ERROR E_UNKNOWN_BUILTIN E_MISSING_FK_TARGET E_PARTIAL_COMPOSITE_FK E_UNKNOWN_EDGE_FIELD E_EDGE_SHAPE_MISMATCH E_UNRESOLVED_REQUIRED_COMPOSITION E_COMPOSITION_NOT_FOUND E_MISSING_TYPE_TAG E_INVALID_TYPE_TAG E_CASE_FOLD_COLLISION",
    "graph": "E_DUPLICATE_PK E_DUPLICATE_COMPOSED_PK E_UNRESOLVED_REQUIRED E_GRAPH_TYPE_NOT_FOUND E_GRAPH_PARENT_NOT_FOUND E_GRAPH_INVALID_COMPOSITION E_GRAPH_MISSING_PK",
}
CATEGORY = {code: category for category, codes in CODES.items() for code in codes.split()}

ISSUE = "struct<phase:int,code:string,severity:string,message:string,path:string,property:string>"
ISSUES = f"array<{ISSUE}>"


def issue(phase: int, code: str, message: str | Column, path: str | Column = "$", prop: str = "", severity: str = "error") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(phase).alias("phase"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), as_column(message).alias("message"), as_column(path).alias("path"), F.lit(prop).alias("property"))


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def severity_counts(issues: DataFrame) -> DataFrame:
    """Rows per severity of a frame that has issue columns."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def of_category(issues: DataFrame, category: str) -> DataFrame:
    return issues.filter(F.col("code").isin(CODES[category].split()))


def sort_issues(issues: Column) -> Column:
    """By path, code, severity and message."""
    keyed = F.transform(issues, lambda x: F.struct(x["path"].alias("path"), x["code"].alias("code"), x["severity"].alias("severity"), x["message"].alias("message"), x["phase"].alias("phase"), x["property"].alias("property")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(*[x[c].alias(c) for c in ("phase", "code", "severity", "message", "path", "property")]))


@dataclass(frozen=True)
class Problem:
    """A diagnostic of the schema compiler."""

    code: str
    message: str
    source: str = ""
    line: int = 0
    severity: str = "error"


@dataclass
class Problems:
    limit: int = 100
    found: list[Problem] = field(default_factory=list)
    dropped: int = 0

    def add(self, code: str, message: str, source: str = "", line: int = 0, severity: str = "error") -> None:
        assert code in CATEGORY, code
        if len(self.found) < self.limit:
            self.found.append(Problem(code, message, source, line, severity))
        else:
            self.dropped += 1

    def merge(self, other: Problems) -> None:
        """The other's diagnostics too, within the limit."""
        for p in other.found:
            self.add(p.code, p.message, p.source, p.line, p.severity)
        self.dropped += other.dropped

    @property
    def ok(self) -> bool:
        return not any(p.severity in ("fatal", "error") for p in self.found)

    def codes(self) -> list[str]:
        return [p.code for p in self.found]

    def sorted(self) -> list[Problem]:
        return sorted(self.found, key=lambda p: (p.source, p.line, p.code, SEVERITIES.index(p.severity), p.message))


def render_text(problems: Problems) -> str:
    """A line per diagnostic, in order of place: source:line: severity[code]: message; and how many there were no room for."""
    lines = []
    for p in problems.sorted():
        place = ":".join(x for x in (p.source, str(p.line) if p.line else "") if x)
        lines.append(f"{place}: {p.severity}[{p.code}]: {p.message}" if place else f"{p.severity}[{p.code}]: {p.message}")
    if problems.dropped:
        lines.append(f"{problems.dropped} more not shown")
    return "\n".join(lines)


def render_json(problems: Problems, indent: int | None = None) -> str:
    """{"issues": [{"severity", "code", "category", "message", "source", "line"}, ...], "dropped": n}; what is not known is left out."""
    issues = []
    for p in problems.sorted():
        full = {"severity": p.severity, "code": p.code, "category": CATEGORY[p.code], "message": p.message, "source": p.source, "line": p.line}
        issues.append({k: v for k, v in full.items() if v not in ("", 0)})
    return json.dumps({"issues": issues, "dropped": problems.dropped}, indent=indent, ensure_ascii=False)


class SchemaError(ValueError):
    def __init__(self, problems: Problems):
        self.problems = problems
        super().__init__("; ".join(f"{p.code}: {p.message}" for p in problems.sorted()[:5]))
