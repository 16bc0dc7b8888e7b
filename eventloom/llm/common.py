"""What several operators share; scratch tables and connected components are those of the library."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import Scratch

__all__ = ["LOWER", "SPACES", "UPPER", "Scratch", "components", "named", "read", "spanning_edges", "words_in_blocks"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def words_in_blocks(texts: Iterable[tuple], most: int = 500_000) -> Iterator[list[tuple]]:
    """Group (key, words) pairs so that a block holds about ``most`` words; one document is never cut."""
    block, held = [], 0
    for key, words in texts:
        block.append((key, words))
        held += len(words)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def spanning_edges(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace links between n local nodes by one link from each node to the smallest of its component."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        differs = a != b
        u, v, a, b = u[differs], v[differs], a[differs], b[differs]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    child = np.nonzero(parent != np.arange(n))[0]
    return child, parent[child]
