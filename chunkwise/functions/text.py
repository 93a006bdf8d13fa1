"""Text column expressions shared by Spark plans and their SQL twins.

Offsets are code points everywhere (Spark ``length``/``substring``/``instr``
count code points), so they agree with Python ``str`` indexing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts (all code points
# below U+30000).  ``strip()`` and ``split()`` of the reference use this set.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a regex class, valid in Java regex and in RE2.
WS_CLASS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Word tokens: lower-cased runs of letters, digits and underscore (Python ``\w``).
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.trim(_c(col), F.lit(WHITESPACE_CHARS))


def is_blank(col) -> Column:
    """``not s.strip()``."""
    return py_strip(col) == F.lit("")


def normalize_ws(col) -> Column:
    """``' '.join(s.lower().split())``."""
    return py_strip(F.regexp_replace(F.lower(_c(col)), WS_CLASS + "+", " "))


def word_tokens(col) -> Column:
    """``re.findall(r'\\b\\w+\\b', s.lower())`` as ARRAY<STRING>."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_PATTERN), 0)


def doc_short(col, max_len: int = 45) -> Column:
    """Readable document label: drop ``.txt``/``.pdf``, ``-``/``_`` to spaces, cut long names."""
    stem = _c(col)
    for old, new in ((".txt", ""), (".pdf", ""), ("-", " "), ("_", " ")):
        stem = F.replace(stem, F.lit(old), F.lit(new))
    return F.when(F.length(stem) > max_len, py_strip(F.substring(stem, 1, max_len))).otherwise(stem)


def pdf_to_txt(col) -> Column:
    return F.replace(_c(col), F.lit(".pdf"), F.lit(".txt"))


def case_name(doc_col, category_col, start_col, prefix_len: int) -> Column:
    """``f"{doc[:p].replace(' ', '_')}__{cat.replace(' ', '_')}__{start}"``."""
    return F.concat(
        F.replace(F.substring(_c(doc_col), 1, prefix_len), F.lit(" "), F.lit("_")),
        F.lit("__"),
        F.replace(_c(category_col), F.lit(" "), F.lit("_")),
        F.lit("__"),
        _c(start_col).cast("string"),
    )


# ---- SQL twins (DuckDB dialect) used by the oracle queries --------------------

SQL_WS_CLASS = WS_CLASS


def sql_strip(expr: str) -> str:
    chars = "".join("chr(%d)" % ord(c) + " || " for c in WHITESPACE_CHARS)[:-4]
    return f"trim({expr}, {chars})"


def sql_normalize_ws(expr: str) -> str:
    return sql_strip(f"regexp_replace(lower({expr}), '{WS_CLASS}+', ' ', 'g')")


def sql_word_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{WORD_PATTERN}', 0)"
