"""Glob patterns over paths as regular expressions that every engine here reads alike.

``*`` and ``?`` stay within a component and don't match a dot at its start; ``**`` stands for any number of
components none of which starts with a dot; classes never match a slash.
"""

from __future__ import annotations

import re


def _component(part: str) -> str:
    out, i = [], 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out.append("(?:[^./][^/]*)?" if i == 0 else "[^/]*")
        elif c == "?":
            out.append("[^./]" if i == 0 else "[^/]")
        elif c == "[":
            end = part.find("]", i + 2 if part[i + 1 : i + 2] in ("!", "^") else i + 1)
            if end < 0:
                raise ValueError(f"an open class in {part!r}")
            body = part[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("/", "").replace("^", "\\^").replace("[", "\\[")
            out.append(f"[^/{body}]" if negated else f"[{body}]" if body else "[^\\s\\S]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_- " else c)
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """The anchored expression of a pattern."""
    parts = [p for p in pattern.split("/") if p]
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append("(?:[^./][^/]*/)*" + ("[^./][^/]*" if last else ""))
        else:
            if "**" in part:
                raise ValueError(f"** is a whole component: {pattern!r}")
            whole = "[^./][^/]*" if part == "*" else _component(part)
            out.append(whole + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def check_glob(pattern: str) -> None:
    try:
        re.compile(glob_regex(pattern))
    except (ValueError, re.error) as e:
        from grovekit.plans.nodes import FilterError

        raise FilterError(f"a bad pattern {pattern!r}: {e}") from e


def literal_prefix(pattern: str) -> str:
    """The directory in front of the first wildcard, with its slash: it reaches the scan as a prefix filter."""
    out = []
    for part in pattern.split("/")[:-1]:
        if re.search(r"[*?\[]", part):
            break
        out.append(part + "/")
    return "".join(out)
