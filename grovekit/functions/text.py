"""Text functions of commits and files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime letters and their patterns here.
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%R": "HH:mm"}


def summary(message: Column) -> Column:
    """The first line."""
    return F.substring_index(message, "\n", 1)


def line_count(text: Column) -> Column:
    """Line feeds and one more, 0 for empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)


def blob_text(content: Column) -> Column:
    """Bytes as text; "" where missing, not UTF-8, or with a NUL."""
    text = F.try_validate_utf8(F.decode(content, "UTF-8"))
    plain = F.when(F.is_valid_utf8(content.cast("string")), text)
    return F.when(plain.isNull() | plain.contains("\x00"), "").otherwise(plain)


def trailers(message: Column) -> Column:
    """The last block of ``Key: value`` lines as an array of (key, value), in order; a message of one block has none."""
    text = F.rtrim(F.regexp_replace(message, r"\s+\z", ""))
    block = F.element_at(F.split(text, "\n[ \t]*\n"), -1)
    rows = F.split(block, "\n")
    ok = text.contains("\n\n") & F.forall(rows, lambda r: r.rlike("^[A-Za-z0-9-]+: "))
    parsed = F.transform(rows, lambda r: F.struct(F.regexp_extract(r, "^([A-Za-z0-9-]+): ", 1).alias("key"), F.regexp_extract(r, "^[A-Za-z0-9-]+: (.*)$", 1).alias("value")))
    return F.when(ok, parsed).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def change_id(message: Column, header: Column | None = None) -> Column:
    """The change id: that of a header, or else the last ``Change`` or ``Change-Id`` trailer."""
    last = F.element_at(F.filter(trailers(message), lambda t: t["key"].isin("Change", "Change-Id")), -1)
    got = F.when(F.size(F.filter(trailers(message), lambda t: t["key"].isin("Change", "Change-Id"))) > 0, last["value"])
    return got if header is None else F.coalesce(header, got)


def change_series(message: Column) -> Column:
    return F.transform(F.filter(trailers(message), lambda t: t["key"] == "Change-Series"), lambda t: t["value"])


def strftime(seconds: Column, form: str) -> Column:
    """A commit's time, in UTC, by a strftime form."""
    import re

    out = []
    for piece in re.split(r"(%[A-Za-z%])", form):
        if piece in _STRFTIME:
            out.append(_STRFTIME[piece])
        elif piece == "%%":
            out.append("'%'")
        elif piece.startswith("%"):
            raise ValueError(f"no form {piece}")
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'" if re.search(r"[A-Za-z']", piece) else piece)
    return F.date_format(F.timestamp_seconds(seconds), "".join(out))


def normal_path(path: Column) -> Column:
    """Components without "" and ".", and ".." resolved; what would leave the root is null."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p != "..", F.concat(s, F.array(p))).when(F.size(s) > 0, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.lit(None)))
    return F.array_join(stack, "/")


def safe_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("%2F"))


def percent_encoded(text: Column) -> Column:
    """All but letters, digits and ``-_.~`` as bytes in percent form."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def rfc3339_seconds(stamp: Column) -> Column:
    """Seconds since 1970 of a time with its offset; null where it can't be read or has none."""
    has_offset = stamp.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(has_offset, F.unix_seconds(F.try_to_timestamp(F.upper(stamp))))


def ref_matches(name: Column, pattern: str) -> Column:
    """Names of references by a glob whose ``*`` crosses slashes."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c not in "_-/" else c for c in pattern)
    return name.rlike(f"^{body}$")
