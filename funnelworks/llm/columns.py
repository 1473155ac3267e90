"""Column expressions that several text operators share. All of them stay in the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # the white space of the contracts
SPACE_CHARS = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what parts folded words in benchmark matching


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str) -> Column:
    return F.coalesce(name(column).cast("string"), F.lit(""))


def fold(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII, the common case, takes the fast function."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, separator: str = SPACE) -> Column:
    return F.array_remove(F.split(text, separator), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def grams(tokens: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` tokens, in order; empty where there are fewer. ``tokens`` must be bound by ``let``."""
    at = F.sequence(F.lit(0), F.size(tokens) - n)
    none = F.array().cast("array<bigint>")
    return F.when(F.size(tokens) >= n, F.transform(
        at, lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(n))))).otherwise(none)


def hex_long(text: Column) -> Column:
    """60 bits of the MD5 of a text; any SQL engine with md5() can repeat it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
