"""The filter algebra: immutable nodes, their canonical text, and their content id."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache

_PLAIN = re.compile(r"[A-Za-z0-9_\-+.*~/]+\Z")


@dataclass(frozen=True)
class Node:
    """An operator and its arguments, which are strings, nodes or tuples of them."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        return spec(self)

    @property
    def filter_id(self) -> str:
        """Equal for structurally equal filters: the digest of the canonical text."""
        return hashlib.sha1(spec(self).encode()).hexdigest()

    def then(self, other: Node) -> Node:
        return chain(self, other)


NOP, EMPTY = Node("nop"), Node("empty")


class FilterError(ValueError):
    """A filter that can't be parsed, inverted or applied."""


def norm(path: str) -> str:
    """A path without empty, ``.`` and resolvable ``..`` components."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                raise FilterError(f"path leaves the root: {path}")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def subdir(path: str) -> Node:
    return Node("subdir", (p,)) if (p := norm(path)) else NOP


def prefix(path: str) -> Node:
    return Node("prefix", (p,)) if (p := norm(path)) else NOP


def file(dst: str, src: str | None = None) -> Node:
    return Node("file", (norm(dst), norm(dst if src is None else src)))


def glob(pattern: str) -> Node:
    return Node("glob", (pattern,))


def chain(*parts: Node) -> Node:
    flat: list[Node] = []
    for p in parts:
        flat += p.args if p.kind == "chain" else [] if p == NOP else [p]
    return NOP if not flat else flat[0] if len(flat) == 1 else Node("chain", tuple(flat))


def compose(*branches: Node) -> Node:
    return Node("compose", tuple(branches))


def exclude(f: Node) -> Node:
    return Node("exclude", (f,))


def select(f: Node) -> Node:
    return Node("select", (f,))


def quoted(s: str) -> str:
    return s if _PLAIN.match(s) else json.dumps(s, ensure_ascii=False)


_string = json.dumps


def _inner(f: Node) -> str:
    """A group's branches."""
    return ",".join(map(spec, f.args)) if f.kind == "compose" and len(f.args) > 1 else spec(f)


@lru_cache(maxsize=10_000)
def spec(n: Node) -> str:
    """One line of text that parses to ``n`` again."""
    k, a = n.kind, n.args
    if k == "chain":
        return "".join(map(spec, a))
    if k == "compose":
        return f":[{','.join(map(spec, a))}]"
    if k in ("exclude", "select", "pin", "linear", "subtract"):
        return f":{k}[{','.join(map(spec, a)) if k == 'subtract' else _inner(a[0])}]"
    if k == "file":
        return f"::{quoted(a[0])}" + (f"={quoted(a[1])}" if a[0] != a[1] else "")
    if k == "meta":
        return f":~({','.join(f'{key}={_string(v)}' for key, v in a[0])})[{_inner(a[1])}]"
    if k == "rev":
        return f":rev({','.join(op + ('' if op == '_' else sha) + spec(f) for op, sha, f in a)})"
    if k == "squash":
        return ":SQUASH" if not a else f":squash({','.join(sha + spec(f) for sha, f in a[0])})"
    if k == "replace":
        return f":replace({','.join(f'{_string(x)}:{_string(y)}' for x, y in a)})"
    if k == "insert":
        return f":${quoted(a[0])}=" + (_string(a[1]) if a[2] == "text" else a[1])
    if k == "message":
        return f":{_string(a[0])}" + (f";{_string(a[1])}" if a[1] != MATCH_ALL else "")
    if k in ("author", "committer"):
        return f":{k}={_string(a[0])};{_string(a[1])}"
    if k == "treeid":
        return f":#{quoted(a[0])}[{_inner(a[1])}]"
    if k == "script":
        return f":!{quoted(a[0])}[{_inner(a[1])}]"
    if k == "unapply":
        return f":unapply({a[0]}{spec(a[1])})"
    if k in _ONE:
        return _ONE[k] + quoted(a[0])
    if k in _BARE:
        return ":" + _BARE[k]
    raise FilterError(f"no text for {k}")


MATCH_ALL = r"(?s)^.*$"
_ONE = {"subdir": ":/", "prefix": ":prefix=", "glob": "::", "stored": ":+", "workspace": ":workspace=", "objectref": ":&", "objectderef": ":#", "hook": ":hook=", "link": ":link=", "adapt": ":adapt=", "downstack": ":_=", "embed": ":embed=", "prune": ":prune="}
_BARE = {"nop": "/", "empty": "empty", "paths": "PATHS", "transpose": "INVERT", "index": "INDEX", "fold": "FOLD", "export": "export", "unlink": "unlink", "unsign": "unsign"}


def pretty(n: Node, depth: int = 0) -> str:
    """Several lines, a branch of a composition each."""
    if n.kind == "compose":
        inner = "\n".join("    " * (depth + 1) + pretty(b, depth + 1) for b in n.args)
        return f":[\n{inner}\n{'    ' * depth}]"
    if n.kind == "chain":
        return "".join(pretty(b, depth) for b in n.args)
    if n.kind in ("exclude", "select", "pin", "linear", "subtract") and n.args[0].kind == "compose":
        inner = "\n".join("    " * (depth + 1) + pretty(b, depth + 1) for b in n.args[0].args)
        return f":{n.kind}[\n{inner}\n{'    ' * depth}]"
    return spec(n)
