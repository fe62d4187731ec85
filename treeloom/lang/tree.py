"""Syntax tree nodes."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """Any node."""


@dataclass(frozen=True)
class Lit(Node):
    value: object


@dataclass(frozen=True)
class Root(Node):
    """The document, ``$``."""


@dataclass(frozen=True)
class Current(Node):
    """The current item, ``@``."""


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Field(Node):
    of: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    """``of[at]`` or ``of.{at}``."""

    of: Node
    at: Node


@dataclass(frozen=True)
class Slice(Node):
    of: Node
    start: Node | None
    stop: Node | None


@dataclass(frozen=True)
class Wild(Node):
    """``of[*]`` or ``of[* if cond]``."""

    of: Node
    cond: Node | None


@dataclass(frozen=True)
class Deep(Node):
    """``of..name``, or ``of..`` without a name."""

    of: Node
    name: str | None


@dataclass(frozen=True)
class Call(Node):
    """``of.name(args)``; without a receiver a free function."""

    of: Node | None
    name: str
    args: tuple = ()
    named: tuple = ()
    deep: bool = False


@dataclass(frozen=True)
class Where(Node):
    """``of{pred}``."""

    of: Node
    pred: Node


@dataclass(frozen=True)
class ExactlyOne(Node):
    of: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    of: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class KindTest(Node):
    of: Node
    kind: str
    negated: bool


@dataclass(frozen=True)
class Cast(Node):
    of: Node
    to: str


@dataclass(frozen=True)
class If(Node):
    cond: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Try(Node):
    body: Node
    other: Node


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple
    body: Node


@dataclass(frozen=True)
class Let(Node):
    name: str
    value: Node
    body: Node


@dataclass(frozen=True)
class Pipe(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Bind(Node):
    """``left -> name``; names is a str, a tuple of positions or a dict-like
    tuple of fields with an optional rest."""

    left: Node
    names: object
    rest: str | None = None
    body: Node | None = None


@dataclass(frozen=True)
class Entry(Node):
    """One entry of an object: key is a str or a node; optional drops nulls."""

    key: object
    value: Node | None
    cond: Node | None = None
    optional: bool = False
    spread: str | None = None


@dataclass(frozen=True)
class Object(Node):
    entries: tuple


@dataclass(frozen=True)
class Array(Node):
    items: tuple
    spreads: tuple = field(default=())


@dataclass(frozen=True)
class Comprehension(Node):
    """kind: list, set or dict (then item is a pair)."""

    kind: str
    item: object
    names: tuple
    source: Node
    cond: Node | None


@dataclass(frozen=True)
class FString(Node):
    """parts: texts, and (node, format or None, pipe or None)."""

    parts: tuple


@dataclass(frozen=True)
class Op(Node):
    """One write of a patch: path steps, a value (None deletes), a guard."""

    path: tuple
    value: Node | None
    cond: Node | None


@dataclass(frozen=True)
class Patch(Node):
    target: Node
    ops: tuple
