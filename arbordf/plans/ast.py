"""Expression trees of the path language."""

from __future__ import annotations

from dataclasses import dataclass

REVERSE_AXES = {"parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}
SIBLING_AXES = {"preceding-sibling", "following-sibling", "preceding", "following"}
AXES = REVERSE_AXES | {"child", "descendant", "descendant-or-self", "self", "attribute", "following", "following-sibling"}


class UnsupportedPath(ValueError):
    """The expression is outside the supported language."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Bin:
    op: str  # or and = != < <= > >= + - * div mod |
    left: object
    right: object


@dataclass(frozen=True)
class Neg:
    arg: object


@dataclass(frozen=True)
class Test:
    __test__ = False  # not a test case

    kind: str  # name any text node comment pi
    name: str | None = None


@dataclass(frozen=True)
class Step:
    axis: str
    test: Test
    predicates: tuple = ()


@dataclass(frozen=True)
class Path:
    """``start`` is None (context), "root" or an expression; ``predicates`` filter the start expression."""

    start: object
    steps: tuple
    predicates: tuple = ()


SELF_OR_BELOW = Step("descendant-or-self", Test("node"))


def fuse(steps: tuple) -> tuple:
    """``//x`` as one descendant step, where no predicate counts positions per parent."""
    out: list = []
    for s in steps:
        if out and out[-1] == SELF_OR_BELOW and s.axis == "child" and not any(positional(p) for p in s.predicates):
            out[-1] = Step("descendant", s.test, s.predicates)
        else:
            out.append(s)
    return tuple(out)


def positional(e) -> bool:
    """Could the predicate depend on position() or last(), or be a number?"""
    if isinstance(e, (Num, Var, Neg)):
        return True
    if isinstance(e, Call):
        return e.name in {"position", "last", "number", "count", "sum", "string-length", "floor", "ceiling", "round"} or any(calls(a, {"position", "last"}) for a in e.args)
    if isinstance(e, Bin):
        return e.op in {"+", "-", "*", "div", "mod"} or calls(e, {"position", "last"})
    return False


def calls(e, names: set[str]) -> bool:
    """Does the expression call one of the functions in its own context (not inside another path's predicate)?"""
    if isinstance(e, Call):
        return e.name in names or any(calls(a, names) for a in e.args)
    if isinstance(e, Bin):
        return calls(e.left, names) or calls(e.right, names)
    if isinstance(e, Neg):
        return calls(e.arg, names)
    return False
