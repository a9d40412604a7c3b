"""Pages from outside: a fetcher that is passed in, tried again with pauses; category crawls; a retried connection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retried(call: Callable, tries: int = 3, wait: float = 5.0, growing: bool = False):
    """Result of ``call``, tried again after ``wait`` seconds (times the number of the try where ``growing``); the last error is raised."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            time.sleep(wait * n if growing else wait)
    return None


def fetch_pages(wanted: DataFrame, key: str, fetch: Callable[[object], str], tries: int = 3, wait: float = 5.0) -> DataFrame:
    """(key, page, error): the page of each key by ``fetch``, which runs on the workers; after the last try the error's text and a null page."""
    kind = wanted.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pitchlake.sources.fetch import retried

        for pdf in batches:
            rows = []
            for k in pdf[key]:
                try:
                    rows.append((k, retried(lambda k=k: fetch(k), tries, wait), None))
                except Exception as e:
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "page", "error"])

    return wanted.select(key).filter(F.col(key).isNotNull()).distinct().mapInPandas(run, f"`{key}` {kind}, page string, error string")


def category_members(links: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """(root, page): the pages of each category and of its subcategories down to ``depth``, each page once a root.

    ``links`` has category, member and is_category; ``roots`` has root. A category that holds itself ends there.
    """
    links = links.filter("category IS NOT NULL AND member IS NOT NULL").distinct()
    level = roots.select("root", F.col("root").alias("category")).distinct()
    seen, pages = level, None
    for d in range(depth + 1):
        found = level.join(links, "category").select("root", "member", "is_category")
        own = found.filter("NOT is_category").select("root", F.col("member").alias("page"))
        pages = own if pages is None else pages.unionByName(own)
        if d < depth:
            level = found.filter("is_category").select("root", F.col("member").alias("category")).distinct().join(seen, ["root", "category"], "left_anti")
            seen = seen.unionByName(level)
    return pages.distinct()
