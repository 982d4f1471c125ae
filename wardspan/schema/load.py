"""Loading schemas: from a file with imports, from a string, or from sources in memory; and a registry of what is loaded."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from pathlib import Path

from ..diag import Problems, SchemaError
from .compiler import check_alias, compile_schema
from .model import Schema, Type
from .parser import parse

class Loader:
    def __init__(self, read: Callable[[str], str | None], problems: Problems, entry: str, imports_allowed: bool = True):
        self.read, self.problems, self.imports_allowed = read, problems, imports_allowed
        self.suffix = posixpath.splitext(entry)[1]  # imports may leave it out
        self.done: dict[str, Schema] = {}
        self.open: list[str] = []

    def load(self, source: str, text: str) -> Schema | None:
        if source in self.done:
            return self.done[source]
        self.open.append(source)
        try:
            name, wanted, types, aliases = parse(text, source, self.problems)
            imports: dict[str, Schema] = {}
            paths: set[str] = set()
            for path, alias, line in wanted:
                if not self.imports_allowed:
                    self.problems.add("E_IMPORT_NOT_ALLOWED", f"import {path!r}: a string has no imports", source, line)
                    continue
                alias = alias or default_alias(path, self.suffix)
                if not check_alias(alias, set(imports) | {t.name for t in types} | set(aliases), self.problems, source, line):
                    continue
                target = self.resolve(source, path, line)
                if target is None:
                    continue
                if target in paths:
                    self.problems.add("E_DUPLICATE_IMPORT", f"{path!r} is imported twice", source, line)
                    continue
                paths.add(target)
                if target in self.open:
                    self.problems.add("E_IMPORT_CYCLE", " -> ".join([*self.open[self.open.index(target) :], target]), source, line)
                    continue
                found = self.load(target, self.read(target) or "")
                if found is None:
                    self.problems.add("E_UPSTREAM_FAIL", f"import {path!r} has errors", source, line)
                else:
                    imports[alias] = found
            if not self.problems.ok:
                return None
            self.done[source] = compile_schema(name, types, aliases, imports, source, self.problems)
            return self.done[source]
        except SchemaError:
            return None
        finally:
            self.open.pop()

    def resolve(self, source: str, path: str, line: int) -> str | None:
        base = posixpath.dirname(source) if path.startswith(".") else ""
        target = posixpath.normpath(posixpath.join(base, path))
        if target.startswith("..") or path.startswith("/"):
            self.problems.add("E_PATH_ESCAPE", f"import {path!r} leaves the module root", source, line)
            return None
        for candidate in (target, target + self.suffix):
            if candidate.endswith(self.suffix) and self.read(candidate) is not None:
                return candidate
        self.problems.add("E_IMPORT_RESOLVE", f"import {path!r} is not found", source, line)
        return None


def default_alias(path: str, suffix: str = "") -> str:
    name = posixpath.basename(path.rstrip("/")).removesuffix(suffix)
    name = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"n{name}" if name[:1].isdigit() else name


def _finish(loader: Loader, source: str, text: str) -> Schema:
    found = loader.load(source, text)
    if found is None or not loader.problems.ok:
        raise SchemaError(loader.problems)
    return found


def load(path: str, root: str | None = None, limit: int = 100) -> Schema:
    """A schema file; imports are read below the root, the file's folder unless told."""
    file = Path(path).resolve()
    top = Path(root).resolve() if root else file.parent

    def read(name: str) -> str | None:
        at = (top / name).resolve()
        return at.read_text(encoding="utf-8") if at.is_relative_to(top) and at.is_file() else None

    if not file.is_relative_to(top):
        problems = Problems(limit)
        problems.add("E_PATH_ESCAPE", f"{path} is outside the module root")
        raise SchemaError(problems)
    return _finish(Loader(read, Problems(limit), file.name), file.relative_to(top).as_posix(), file.read_text(encoding="utf-8"))


def load_string(text: str, source: str = "<string>", limit: int = 100) -> Schema:
    """A schema's text; imports are refused."""
    return _finish(Loader(lambda _: None, Problems(limit), source, imports_allowed=False), source, text)


def load_sources(sources: dict[str, str], entry: str | None = None, limit: int = 100) -> Schema:
    """Schemas in memory by path; the entry is the first by path unless told."""
    if not sources or (entry is not None and entry not in sources):
        problems = Problems(limit)
        problems.add("E_IMPORT_RESOLVE", f"no source {entry!r}")
        raise SchemaError(problems)
    entry = entry or min(sources)
    return _finish(Loader(sources.get, Problems(limit), entry), entry, sources[entry])


class Registry:
    """Schemas by source and by name; each of them once."""

    def __init__(self) -> None:
        self.by_source: dict[str, Schema] = {}
        self.by_name: dict[str, Schema] = {}

    def register(self, schema: Schema) -> None:
        if not schema.source:
            raise ValueError("E_MISSING_SOURCE_ID: a registered schema needs a source")
        if schema.source in self.by_source or schema.name in self.by_name:
            raise ValueError(f"{schema.name} ({schema.source}) is registered already")
        self.by_source[schema.source] = self.by_name[schema.name] = schema

    def type(self, type_id: str) -> Type | None:
        source, _, name = type_id.rpartition("#")
        schema = self.by_source.get(source) or self.by_name.get(source)
        return schema.types.get(name) if schema else None
