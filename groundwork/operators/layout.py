"""Reading order of boxes on a page, and measures of an order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: Depth of cuts, and how much wider a gutter must be than a row gap to cut first.
LEVELS, RATIO = 16, 1.2


def _gap(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """The widest gap between merged spans: width and middle."""
    best, reach = (0.0, 0.0), None
    for a, b in sorted(spans):
        if reach is not None and a - reach > best[0]:
            best = (a - reach, (a + reach) / 2)
        reach = b if reach is None else max(reach, b)
    return best


def reading_order(boxes: list[tuple[int, float, float, float, float]], level: int = 0) -> list[int]:
    """Ids of boxes (id, x0, y0, x1, y1) by recursive cuts at the widest clear gap, columns before rows if their gap rules."""
    by_row = [b[0] for b in sorted(boxes, key=lambda b: (b[2], b[1]))]
    if len(boxes) < 2 or level >= LEVELS:
        return by_row
    gutter, x = _gap([(b[1], b[3]) for b in boxes])
    rows, y = _gap([(b[2], b[4]) for b in boxes])
    tall = min(len([b for b in boxes if b[3] <= x]), len([b for b in boxes if b[1] >= x])) >= 2
    if gutter > 0 and gutter >= RATIO * rows and tall:
        parts = [b for b in boxes if b[3] <= x], [b for b in boxes if b[1] >= x]
    elif rows > 0:
        parts = [b for b in boxes if b[4] <= y], [b for b in boxes if b[2] >= y]
    elif gutter > 0:
        parts = [b for b in boxes if b[3] <= x], [b for b in boxes if b[1] >= x]
    else:
        return by_row
    return [i for p in parts for i in reading_order(p, level + 1)]


def order_pages(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, idx, text, x0, y0, x1, y1) with ``rank`` from 0; one page is one task's group."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        order = reading_order([tuple(r) for r in page[["idx", "x0", "y0", "x1", "y1"]].itertuples(index=False)])
        place = {i: k for k, i in enumerate(order)}
        return page[["page_id", "idx", "text"]].assign(rank=page["idx"].map(place))

    return blocks.groupBy("page_id").applyInPandas(run, "page_id string, idx int, text string, rank int")


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def transcription_measures(expected: str, got: str) -> dict[str, float]:
    """Characters without white space: kept in order, added and lost."""
    from collections import Counter
    from unicodedata import normalize

    e, g = ("".join(normalize("NFKC", x or "").split()) for x in (expected, got))
    common, added, lost = lcs(list(e), list(g)), sum((Counter(g) - Counter(e)).values()), sum((Counter(e) - Counter(g)).values())
    return {"exact": float(e == g), "recall": common / max(1, len(e)), "precision": common / max(1, len(g)), "added": added, "lost": lost}


def order_measures(expected: list, got: list) -> dict[str, float]:
    """exact, conserved (as multisets), share of the common subsequence, share of kept neighbours."""
    near = set(zip(got, got[1:], strict=False))
    pairs = list(zip(expected, expected[1:], strict=False))
    return {
        "exact": float(expected == got), "conserved": float(sorted(expected) == sorted(got)),
        "lcs": lcs(expected, got) / max(1, len(expected)), "adjacent": sum(p in near for p in pairs) / max(1, len(pairs)),
    }
