"""Path expressions, all built in except NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def path_change(old: Column, new: Column) -> Column:
    """'move' if only the folder changes, otherwise 'rename' (also when both change)."""
    return F.when((base_name(old) == base_name(new)) & (dir_name(old) != dir_name(new)), "move").otherwise("rename")


def ancestors(path: Column) -> Column:
    """Every proper folder prefix of a path; none for a file at the root."""
    parts = F.split(path, "/", -1)
    n = F.size(parts) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def under(path: Column, prefix: Column | str) -> Column:
    return F.startswith(path, F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("/")))


def rebased(path: Column, prefix: Column | str) -> Column:
    """path below prefix without it; other paths unchanged. '' and '.' are no prefix."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.when(~p.isin("", ".") & under(path, p), F.substring(path, F.length(p) + 2, F.length(path))).otherwise(path)


@F.pandas_udf(StringType())
def nfc(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))
