import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n", "a", "one two", "\n\n x \t\r\n", "é ü ñ 你好 🙂  x", "don't  stop\n\n  now", "x" * 30_000, "ab " * 9_000, "same text here", "same text here"]


@pytest.fixture(scope="session")
def folder():
    return FOLDER


def with_clashes(df):
    """The table with more columns, named like those that operators make for themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "fp", "key", "row", "pos", "h", "n", "doc", "item", "score", "component", "node", "t", "base"):
        df = df.withColumn(name, F.lit("clash"))
    return df


class Links:
    """Union-find by the least name, for brute-force components."""

    def __init__(self, names):
        self.up = {x: x for x in names}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x
