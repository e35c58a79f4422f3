"""Log templates by a fixed-depth parse tree, per key, merged over partitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WILD = "<*>"


class ParseTree:
    """Online clustering: by token count, then by the first ``depth`` tokens, then by token similarity."""

    def __init__(self, depth: int = 2, similarity: float = 0.4, most_children: int = 100) -> None:
        self.depth, self.similarity, self.most_children = depth, similarity, most_children
        self.nodes: dict[tuple, dict] = {}
        self.leaves: dict[tuple, list[list]] = {}

    def _leaf(self, words: list[str]) -> list[list]:
        path: tuple = (len(words),)
        for word in words[: self.depth]:
            children = self.nodes.setdefault(path, {})
            name = WILD if any(c.isdigit() for c in word) or (word not in children and len(children) >= self.most_children) else word
            children[name] = True
            path = (*path, name)
        return self.leaves.setdefault(path, [])

    def add(self, words: list[str], count: int = 1) -> None:
        leaf = self._leaf(words)
        best, most = None, -1.0
        for cluster in leaf:
            same = sum(a == b for a, b in zip(cluster[0], words, strict=True)) / max(1, len(words))
            if same > most:
                best, most = cluster, same
        if best is not None and most >= self.similarity:
            best[0] = [a if a == b else WILD for a, b in zip(best[0], words, strict=True)]
            best[1] += count
        else:
            leaf.append([list(words), count])

    def templates(self) -> Iterator[tuple[str, int]]:
        for leaf in self.leaves.values():
            for words, count in leaf:
                yield " ".join(words), count


def mine(lines: DataFrame, key: str, line: str, shortest: int = 8) -> DataFrame:
    """(key, template, n): templates of masked lines of at least ``shortest`` characters, per key.

    Each partition grows its own trees; equal templates then collapse in an
    aggregate, and only templates, never lines, meet per key for the merge.
    The order of lines can shift borderline clusters, as in any online method.
    NULL keys form a group of their own; NULL and short lines are skipped.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str | None, ParseTree] = {}
        for batch in batches:
            for k, text in zip(batch["key"], batch["line"], strict=True):
                masked = re.sub(r"\b[0-9]+\b", "<NUM>", text)
                trees.setdefault(k, ParseTree()).add(masked.split())
        yield pd.DataFrame([(k, t, n) for k, tree in trees.items() for t, n in tree.templates()], columns=["key", "template", "n"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        tree = ParseTree()
        for template, n in frame.sort_values(["n", "template"], ascending=[False, True])[["template", "n"]].itertuples(index=False):
            tree.add(template.split(), n)
        return pd.DataFrame([(frame["key"].iloc[0], t, n) for t, n in tree.templates()], columns=["key", "template", "n"])

    schema = "key string, template string, n bigint"
    kept = lines.select(F.col(key).cast("string").alias("key"), F.trim(line).alias("line")).where(F.length("line") >= shortest)
    equal = kept.mapInPandas(local, schema).groupBy("key", "template").agg(F.sum("n").alias("n"))
    return equal.groupBy("key").applyInPandas(merge, schema)
