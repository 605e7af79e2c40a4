"""The restricted predicate dialect of subscriptions.

The text is parsed by Spark's own parser through ``expr``; before that a scanner
admits only the words of the dialect: columns, literals, operators, NOT, IS,
BETWEEN, LIKE, SIMILAR TO, IN lists, CAST, and five string functions.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PredicateParse(ValueError):
    pass


class PredicateUnsupported(ValueError):
    pass


# Functions of the dialect and their names in Spark SQL.
FUNCTIONS = {"lower": "lower", "upper": "upper", "length": "length", "starts_with": "startswith", "ends_with": "endswith", "cast": "cast", "try_cast": "try_cast"}
REFUSED = ("select", "case", "when", "over", "exists", "group", "order", "union", "join", "from", "with")
TOKENS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\d+(?:\.\d+)?|[A-Za-z_]\w*|<=|>=|<>|!=|\|\||\S")
AFTER_WORD_OK = {"in", "and", "or", "not", "between", "like", "varchar", "char", "decimal", "is", "to"}


def _similar(tokens: list[str]) -> list[str]:
    """``x SIMILAR TO 'pattern'`` as a match of the whole value: ``%`` and ``_`` as in LIKE, and
    ``| * + ? { } ( ) [ ]`` as in regular expressions."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].lower() == "similar" and i + 2 < len(tokens) and tokens[i + 1].lower() == "to" and tokens[i + 2][0] == "'":
            pattern, inside = "", False
            for c in tokens[i + 2][1:-1].replace("''", "'"):
                inside = (inside or c == "[") and c != "]"
                c = c if inside else {"%": "(?s:.*)", "_": "(?s:.)"}.get(c, "\\" + c if c in ".$^\\" else c)
                pattern += c
            literal = f"^(?:{pattern})$".replace("\\", "\\\\").replace("'", "\\'")
            out += ["rlike", f"'{literal}'"]
            i += 3
        else:
            out.append(tokens[i])
            i += 1
    return out


def compile_predicate(text: str | None) -> Column | None:
    """The column of a predicate, or None for the empty one, which all rows match."""
    if text is None or not text.strip():
        return None
    tokens = TOKENS.findall(text)
    out = []
    for i, token in enumerate(tokens):
        low, nxt = token.lower(), tokens[i + 1] if i + 1 < len(tokens) else ""
        if token == ";":
            raise PredicateParse(text)
        if re.fullmatch(r"[A-Za-z_]\w*", token):
            if low in REFUSED:
                raise PredicateUnsupported(low)
            if nxt == "(" and low not in AFTER_WORD_OK:
                if low not in FUNCTIONS:
                    raise PredicateUnsupported(f"function {token}")
                token = FUNCTIONS[low]
        elif token[0] == '"':
            token = "`" + token[1:-1].replace('""', '"') + "`"
        out.append(token)
    sql = " ".join(_similar(out))
    try:
        return F.expr(sql)
    except ParseException as e:
        raise PredicateParse(text) from e


def matching(df: DataFrame, text: str | None) -> DataFrame:
    """The rows of ``df`` that the predicate holds for."""
    column = compile_predicate(text)
    try:
        return df if column is None else df.filter(column)
    except ParseException as e:
        raise PredicateParse(text) from e
    except AnalysisException as e:
        raise PredicateUnsupported(str(e)) from e
