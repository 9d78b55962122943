"""Substring search through a stored index of three-letter pieces (F2).

The index holds (col, piece, key) for every three-letter piece of every
searched column, in lower case.  A term is cut at its wildcards; a row can
match only if one of its columns has all pieces of all parts, so the index
gives the rows that are then tested exactly by ``search_cond``.  A term
without a part of three letters is searched by the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .listing import search_cond

PIECE = 3


def pieces_index(df: DataFrame, cols: list[str], key: str = "id") -> DataFrame:
    """(col, piece, key) of ``df``, each once."""
    out = []
    for c in cols:
        text = F.lower(F.col(c))
        at = F.when(F.length(text) >= PIECE, F.sequence(F.lit(1), F.length(text) - PIECE + 1))
        found = F.transform(at, lambda i: F.substring(text, i, F.lit(PIECE)))
        out.append(df.select(F.lit(c).alias("col"), F.explode(F.array_distinct(found)).alias("piece"), F.col(key).alias("key")))
    return reduce(DataFrame.unionByName, out)


def store_index(df: DataFrame, cols: list[str], path: str, key: str = "id") -> None:
    """Write the index sorted by piece, so that a search skips the row groups
    of other pieces."""
    (pieces_index(df, cols, key).repartitionByRange("piece", "key").sortWithinPartitions("piece", "col", "key")
     .write.parquet(path))


def _term_pieces(spark, term: str) -> list[str]:
    """Pieces of the parts of ``term`` between wildcards and escapes, folded
    as the search folds (one row through the driver)."""
    folded = spark.range(1).select(F.lower(F.lit(term))).first()[0]
    parts = re.split(r"[%_\\]", folded)
    return sorted({p[i:i + PIECE] for p in parts for i in range(len(p) - PIECE + 1)})


def indexed_search(df: DataFrame, index: DataFrame, term: str, cols: list[str], key: str = "id") -> DataFrame:
    """The rows of ``df`` that :func:`listing.search_cond` finds, by way of
    ``index`` (of the same table and columns)."""
    pieces = _term_pieces(df.sparkSession, term)
    if not pieces:
        return df.filter(search_cond(term, cols))
    hits = (index.filter(F.col("piece").isin(pieces) & F.col("col").isin(cols)).groupBy("key", "col")
            .agg(F.count_distinct("piece").alias("n")).filter(F.col("n") == len(pieces)).select("key").distinct())
    return df.join(hits, df[key] == hits["key"], "left_semi").filter(search_cond(term, cols))
