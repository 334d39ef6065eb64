"""Column expressions on text shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that only say that a value is missing (compared lower-cased and trimmed).
STAND_INS = ["n/a", "na", "null", "nil", "unknown", "tbd", "-", "--", "---", "?", "??", "none", "todo", "not available", "not applicable", "missing", "undefined", "."]

#: The scanners; every other name is an agent's.
SCANNERS = ["semgrep", "bandit", "trivy", "gitleaks", "npm_audit"]


def strip(c: Column) -> Column:
    """Without outer white space of any kind (SQL trim only removes spaces)."""
    return F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")


def folded(c: Column) -> Column:
    """Lower case without outer white space: the form in which ids and sources are compared."""
    return F.lower(strip(c))


def is_stand_in(c: Column) -> Column:
    return folded(c).isin(STAND_INS)


def usable(c: Column) -> Column:
    """Not null, blank or a stand-in; never null itself."""
    f = folded(c)
    return F.coalesce((f != "") & ~f.isin(STAND_INS), F.lit(False))


def key_or_null(c: Column) -> Column:
    """The folded id, null where there is none."""
    f = folded(c)
    return F.when(f != "", f)


def contains_any(text: Column, words: list[str]) -> Column:
    """True if the text holds one of the words; unrolled so that it folds and short-circuits in generated code."""
    out = F.lit(False)
    for w in reversed(words):
        out = F.contains(text, F.lit(w)) | out
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def py_title(c: Column) -> Column:
    """Title case that starts anew after every non-letter (initcap only does after white space)."""
    parts = F.regexp_extract_all(c, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")
