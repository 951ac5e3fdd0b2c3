"""Globs as regular expressions: '**' any characters, '*' any but '/', '?' one but
'/', '[…]' and '[!…]' classes; a class that isn't closed is literal."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def to_regex(glob: str) -> str:
    """An expression for the whole of a path."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + glob.startswith("!", i + 1)) if c == "[" else -1
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            if body.startswith("!"):
                out.append(f"[^/{body[1:]}]")
            else:
                out.append(f"[{'\\' if body.startswith('^') else ''}{body}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^(?:{''.join(out)})\\z"


@F.pandas_udf(StringType())
def _rules(globs: pd.Series) -> pd.Series:
    return globs.map(to_regex, na_action="ignore")


def regex_of(column: str) -> Column:
    """The expression of each glob of a column."""
    return _rules(F.col(column))


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a path matches any of the globs; false for none."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{to_regex(g)})" for g in globs))


def is_glob(s: Column) -> Column:
    return s.rlike(r"[*?\[]")
