"""One SQL statement given by a user: is it read-only, and with which parameters."""

from __future__ import annotations

import re

from ..functions import fixed_values as fv

_SPACE = "[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", fv.SPACE_CLASS) + "]"
_FORBIDDEN = re.compile(
    rf"\b(?:(?:{'|'.join(fv.FORBIDDEN_WORDS)})\b|create{_SPACE}+(?!extension))", re.ASCII
)
# quoted text and comments are skipped, so only markers outside them count
_MARKER = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(\d+)", re.DOTALL)


def bare_statement(sql: str) -> str:
    sql = re.sub(r"/\*.*?\*/", "", sql, flags=re.DOTALL)
    return re.sub(r"--[^\n]*", "", sql).strip(fv.SPACE_CHARS).lower()


def without_tail(sql: str) -> str:
    """The statement without comments, which quotes protect, and without closing semicolons."""
    bare = _MARKER.sub(lambda m: " " if m[0].startswith(("--", "/*")) else m[0], sql)
    return bare.strip(fv.SPACE_CHARS + ";")


def check_read_only(sql: str) -> None:
    """Refuse anything but read statements; see `classify_statements` for a log."""
    bare = bare_statement(sql)
    if not bare.startswith(fv.ALLOWED_PREFIXES):
        raise PermissionError("statement type not allowed")
    if _FORBIDDEN.search(bare):
        raise PermissionError("forbidden operation")


def named_parameters(sql: str, args: list) -> tuple[str, list | dict]:
    """Turn positional markers ``$1, $2`` into Spark's named ones, if there are any."""
    renamed = _MARKER.sub(lambda m: f":p{m[1]}" if m[1] else m[0], sql)
    if renamed == sql:
        return sql, args
    return renamed, {f"p{i}": value for i, value in enumerate(args, start=1)}
