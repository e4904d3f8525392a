"""Texts of 100,000 characters through the splits that repeat a negated pattern."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import pretokenizers as P

EMOJI = "a\U0001f600" * 50_000
MARKED = "a<\U0001f600>" * 25_000
AB = "ab" * 50_000
PLAIN = "x" * 100_000


@pytest.mark.parametrize("behavior", ["isolated", "merged_with_previous", "merged_with_next", "contiguous", "removed"])
@pytest.mark.parametrize("pattern", ["[<>]", "a|b", "x"])
def test_splits_of_long_texts(spark, behavior, pattern):
    texts = [EMOJI, MARKED, AB, PLAIN, "  " + PLAIN]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.split(pattern, behavior)(F.col("t")).alias("s")).collect()]
    for text, parts in zip(texts, got, strict=True):
        spans = [m.span() for m in re.finditer(pattern, text)]
        cuts = {0, len(text)}
        if behavior == "merged_with_previous":
            cuts |= {b for _, b in spans}
        elif behavior == "merged_with_next":
            cuts |= {a for a, _ in spans[1:]}
        elif behavior == "contiguous":
            cuts |= {a for (_, p), (a, _) in zip([(0, -1), *spans], spans) if a != p} | {b for (_, b), (a, _) in zip(spans, [*spans[1:], (-1, 0)]) if a != b}
        else:
            cuts |= {x for s in spans for x in s}
        edges = sorted(cuts)
        want = [text[i:j] for i, j in zip(edges, edges[1:])]
        if behavior == "removed":
            want = [w for w in want if not re.fullmatch(pattern, w)]
        if behavior == "merged_with_next" and not spans:
            want = []
        assert parts == want


def test_metaspace_of_long_texts(spark):
    texts = [EMOJI, "a \U0001f600" * 30_000]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.metaspace()(F.col("t")).alias("s")).collect()]
    assert ["".join(s) for s in got] == ["▁" + t.replace(" ", "▁") for t in texts] and [len(s) for s in got] == [2, 30_002]
