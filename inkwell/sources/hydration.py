"""Article bodies from the state that pages carry for their scripts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import structured_bodies

# Keys that hold bodies, the least length of one, and limits of the search.
BODY_KEYS = ("articleBody", "body", "bodyHtml", "content", "contentHtml")
LEAST_BODY, TEASER, LONGEST_BODY = 600, 600, 512 * 1024
MAX_STATE, MAX_DEPTH, MAX_LIST, MAX_KEYS, MAX_VALUES = 4 * 1024 * 1024, 14, 64, 256, 20_000
_STATE = re.compile(r"""(?is)<script[^>]*\bid\s*=\s*["']?__NEXT_DATA__["']?[^>]*>(.*?)</script>""")


def longest_body(state: object) -> str | None:
    """The longest text of prose length under a key for bodies, wherever it stands in decoded JSON; the first of equal ones."""
    best, left = None, MAX_VALUES
    stack = [(state, 0)]
    while stack and left:
        value, depth = stack.pop()
        left -= 1
        if depth >= MAX_DEPTH:
            continue
        if isinstance(value, list):
            stack += [(v, depth + 1) for v in reversed(value[:MAX_LIST])]
        elif isinstance(value, dict):
            for key in BODY_KEYS:
                text = value.get(key)
                if isinstance(text, str) and len(text) >= LEAST_BODY and ". " in text and len(text.encode("utf-8", "replace")) <= LONGEST_BODY and len(text) > len(best or ""):
                    best = text
            stack += [(v, depth + 1) for v in reversed(list(value.values())[:MAX_KEYS]) if isinstance(v, (dict, list))]
    return best


def state_body(html: str) -> str | None:
    """``longest_body`` of a page's script state; None where there is none or it can't be read."""
    found = _STATE.search(html)
    if not found or len(found[1]) > MAX_STATE:
        return None
    try:
        return longest_body(json.loads(found[1]))
    except (ValueError, RecursionError):
        return None


def page_bodies(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, body): each page's longest body: that of its JSON-LD, or of its script state where that is missing or a teaser; the longer wins.

    Only pages whose JSON-LD is short and that carry state go through Python. Pages without a body have a null one.
    """
    linked = F.array_max(F.transform(structured_bodies(F.col(html_col)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    pages = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), linked.alias("linked"))
    carries = (F.coalesce(F.length("linked"), F.lit(0)) < TEASER) & F.col("html").contains("__NEXT_DATA__")
    done = pages.where(~F.coalesce(carries, F.lit(False))).select("id", F.col("linked").alias("body"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [max((state_body(h) or "", t or ""), key=len) or None for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["id", "body"])

    return done.unionByName(pages.where(carries).mapInArrow(batches, f"id {dict(pages.dtypes)['id']}, body string"))
