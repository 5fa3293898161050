"""Syntax of patterns, and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Diagnostic:
    """A finding about a query: its kind, the message, and the span in code points of the source it was found in."""

    kind: str
    message: str
    start: int
    end: int
    source: str = "query"
    severity: str = "error"

    def located(self, text: str) -> tuple[int, int]:
        """Line and column of the start, both from 1."""
        before = text[: self.start]
        return before.count("\n") + 1, self.start - (before.rfind("\n") + 1) + 1


class QueryError(ValueError):
    """A query that does not compile; ``diagnostics`` says why."""

    def __init__(self, diagnostics: list[Diagnostic]):
        self.diagnostics = diagnostics
        super().__init__("; ".join(f"{d.kind}: {d.message}" for d in diagnostics))


@dataclass(eq=False)
class Pattern:
    start: int = field(default=0, kw_only=True)
    end: int = field(default=0, kw_only=True)


@dataclass(eq=False)
class Node(Pattern):
    """``(kind ...)``, ``(_ ...)``, ``_``, ``"text"``, ``(ERROR)`` or ``(MISSING ...)``."""

    kind: str | None = None
    named: bool | None = True  # None: either
    missing: bool = False
    predicate: tuple[str, str] | None = None
    items: list[Item] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    body: bool = False  # written with children, anchors or both


@dataclass(eq=False)
class Ref(Pattern):
    name: str = ""


@dataclass(eq=False)
class Seq(Pattern):
    items: list[Item] = field(default_factory=list)


@dataclass(eq=False)
class Alt(Pattern):
    options: list[tuple[str | None, Pattern]] = field(default_factory=list)

    @property
    def labelled(self) -> bool:
        return bool(self.options) and all(label for label, _ in self.options)


@dataclass(eq=False)
class Quant(Pattern):
    inner: Pattern = None
    least: int = 0
    many: bool = False
    lazy: bool = False


@dataclass(eq=False)
class Field(Pattern):
    name: str = ""
    inner: Pattern = None


@dataclass(eq=False)
class Capture(Pattern):
    inner: Pattern = None
    name: str | None = None  # None: discard
    type: str | None = None


@dataclass(eq=False)
class Anchor(Pattern):
    exact: bool = False


Item = Pattern


@dataclass(eq=False)
class Definition:
    name: str
    body: Pattern
    source: str
    start: int
    end: int


def children(p: Pattern) -> list[Pattern]:
    """The patterns directly inside one, without anchors."""
    if isinstance(p, Node | Seq):
        return [i for i in p.items if not isinstance(i, Anchor)]
    if isinstance(p, Alt):
        return [x for _, x in p.options]
    return [p.inner] if isinstance(p, Quant | Field | Capture) else []
