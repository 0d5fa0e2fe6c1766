"""Text functions. All but the Unicode normal forms are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space as a character class; fixed values.
WS = r"\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
#: Accents that a slug maps to plain letters, all others become separators; fixed values.
SLUG_FROM, SLUG_TO = "\u00E0\u00E2\u00E7\u00E9\u00E8\u00EA\u00EB\u00EE\u00EF\u00F4\u00F9\u00FB\u00FC", "aaceeeeiiouuu"
#: Typographic characters and what citations compare them as; fixed values.
CITE_FROM, CITE_TO = "\u2018\u2019\u201C\u201D\u2010\u2011\u2013\u2014\u00A0", "''\"\"---- "


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def slugify(c: Column) -> Column:
    plain = F.translate(F.lower(normalize_whitespace(c)), SLUG_FROM, SLUG_TO)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_whitespace(c), 256)


def split_lines(c: Column) -> Column:
    """Lines; a line end at the very end starts no line."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_END})$", ""), LINE_END)


HEADING = f"^(#{{1,6}})[{WS}]+(.+?)[{WS}]*$"


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 for a line that is no heading."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_citation(c: Column) -> Column:
    """NFKC, plain quotes and hyphens, single spaces; case is kept."""
    return normalize_whitespace(F.translate(nfkc(c), CITE_FROM, CITE_TO))


_NOT_WORD = re.compile(r"[\W_]+")


def evaluation_form(text: str) -> str:
    """Case-folded letters and digits without accents, single spaces."""
    bare = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return " ".join(_NOT_WORD.sub(" ", bare.casefold()).split())


@F.pandas_udf(T.StringType())
def normalize_evaluation(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else evaluation_form(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_evaluation_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [evaluation_form(x) for x in xs])


@F.pandas_udf(T.StringType())
def fixed_point(s: pd.Series, digits: pd.Series) -> pd.Series:
    """Text with so many decimals, rounding the exact binary value (``format_string`` rounds halves of the decimal one)."""
    return pd.Series([None if pd.isna(x) else f"{x:.{int(d)}f}" for x, d in zip(s, digits, strict=True)])


def metric_label(c: Column) -> Column:
    return F.coalesce(fixed_point(c, F.lit(3)), F.lit("N/A"))


def location_label(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("pages "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise("Markdown section")


def excerpt(c: Column, length: int = 600) -> Column:
    return F.substring(c, 1, length)
