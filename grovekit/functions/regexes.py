"""Patterns and replacements of the filter language in the engine's dialect.

A pattern's groups all become unnamed, so that names need not be what the engine allows; references to
them go by number. ``$name`` takes the longest name, ``${name}`` is the same with its end shown, ``$$`` is a
dollar, and a group that isn't there is empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.]*)>")
_REFERENCE = re.compile(r"\$(?:(\$)|\{([^}]*)\}|([A-Za-z0-9_]+))")


def unnamed(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern without names of groups, and the number of each group by its name and by its number as text."""
    out, groups, i, in_class = [], {"0": 0}, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "(" and not in_class:
            named = _NAMED.match(pattern, i)
            if named or not pattern.startswith("(?", i):
                n = sum(k.isdigit() for k in groups)
                groups[str(n)] = n
                if named:
                    groups[named[1]] = n
                out.append("(")
                i = named.end() if named else i + 1
                continue
        out.append(c)
        i += 1
    return "".join(out), groups


def literal(text: str, digit_first: bool = False) -> str:
    """Text that stands for itself in a replacement; a digit after a group's number is kept from it."""
    text = text.replace("\\", "\\\\").replace("$", "\\$")
    return "\\" + text if digit_first and text[:1].isdigit() else text


def replacement(text: str, groups: dict[str, int], reference: re.Pattern = _REFERENCE, name_of: Callable = lambda m: m[2] if m[2] is not None else m[3]) -> str:
    """A replacement text with its references as numbers."""
    out, at, after = [], 0, False

    def put(piece: str) -> None:
        nonlocal after
        if piece:
            out.append(literal(piece, after))
            after = False

    for m in reference.finditer(text):
        put(text[at : m.start()])
        at = m.end()
        if m[1]:
            put("$")
        elif (n := groups.get(name_of(m))) is not None:
            out.append(f"${n}")
            after = True
    put(text[at:])
    return "".join(out)
