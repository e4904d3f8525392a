"""Counts of words: each worker counts a partition's words and hands on one row a distinct word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import ship

#: Distinct words that a worker holds before it hands on their counts.
HELD = 200_000


def count_words(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """w, n: every match of the pattern in a text column, with how often it occurs."""
    ship(df.sparkSession)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = _finder(pattern), Counter()
        for batch in given:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(find(t))
            if len(counts) > HELD:
                yield from _batches(counts)
                counts = Counter()
        yield from _batches(counts)

    return df.select(text).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=8)
def _finder(pattern: str):
    """``findall``; runs of one class of characters without white space are parted by spaces."""
    one = pattern.removesuffix("+")
    if pattern == one or not _CLASS.fullmatch(one):
        return regex.compile(pattern).findall
    inside = np.zeros(0x110000, bool)
    inside[[ord(c) for c in regex.findall(one, "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))]] = True
    if inside[[ord(c) for c in map(chr, range(0x3001)) if c.isspace()]].any():
        return regex.compile(pattern).findall

    def find(text: str) -> list[str]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(inside[points], points, 32).astype("<u4").tobytes().decode("utf-32-le").split()

    return find


#: A property, or a class without classes within it.
_CLASS = regex.compile(r"\\p\{\w+\}|\[[^\[\]\\]+\]")


def _batches(counts: Counter) -> Iterator[pa.RecordBatch]:
    words, numbers = list(counts), list(counts.values())
    for i in range(0, len(words), 10_000):
        yield pa.record_batch([pa.array(words[i : i + 10_000], pa.string()), pa.array(numbers[i : i + 10_000], pa.int64())], names=["w", "n"])
