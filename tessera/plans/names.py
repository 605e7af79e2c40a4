"""Identifiers, and three-part relation names in SQL text.

``source.public.table`` can't be a Spark identifier of a single-part namespace, so
each relation is a temporary view whose one name holds the dots, and the SQL text
is rewritten: a scanner skips strings, comments and quoted names, and replaces
dotted paths that name a registered relation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

TOKEN = re.compile(
    r"""(?P<skip>'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/)|(?P<path>(?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|[A-Za-z_][A-Za-z0-9_]*)(?:\s*\.\s*(?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|[A-Za-z_][A-Za-z0-9_]*))*)""",
    re.S,
)
PART = re.compile(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|[A-Za-z_][A-Za-z0-9_]*')


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_relation(dotted: str) -> str:
    return ".".join(quote_ident(p) for p in dotted.split("."))


def source_relation(source: str, table: str) -> str:
    return f"{source}.public.{table}"


def table_of(path: str) -> str:
    """A file's table name: its base name before the first dot."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]


def _bare(part: str) -> str:
    return part[1:-1].replace(part[0] * 2, part[0]) if part[0] in "\"`" else part


def rewrite(sql: str, known: Callable[[str], str | None]) -> str:
    """``sql`` with each known dotted (or quoted) path replaced by its view's quoted name.

    A path longer than a relation's name keeps its last part as a column.
    """

    def change(m: re.Match) -> str:
        if m["skip"] is not None:
            return m[0]
        parts = PART.findall(m["path"])
        bare = [_bare(p) for p in parts]
        for n in (len(bare), len(bare) - 1):
            if n and (n > 1 or parts[0][0] in "\"`") and (view := known(".".join(bare[:n]))):
                return ".".join(["`" + view.replace("`", "``") + "`", *("`" + b + "`" for b in bare[n:])])
        if any(p[0] == '"' for p in parts):
            return ".".join("`" + b.replace("`", "``") + "`" for b in bare)
        return m[0]

    text = TOKEN.sub(change, sql)
    return re.sub(r"(?i)\barrow_cast\s*\(\s*([^(),]+(?:\([^()]*\))?)\s*,\s*'(\w+)'\s*\)", lambda m: f"CAST({m[1]} AS {ARROW.get(m[2], m[2])})", text)


# Names of columnar types and the SQL types they are cast to.
ARROW = {"Utf8": "STRING", "LargeUtf8": "STRING", "Float64": "DOUBLE", "Float32": "FLOAT", "Int64": "BIGINT", "Int32": "INT", "Int16": "SMALLINT", "Int8": "TINYINT", "Boolean": "BOOLEAN", "Date32": "DATE"}
