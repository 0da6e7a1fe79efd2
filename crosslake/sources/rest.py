"""REST sources with offset, cursor or link paging, as rows of JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch, local_rows

CHUNK_ITEMS = 50_000
Fetch = Callable[[str, dict], tuple[object, dict]]


def _at(doc: object, path: str | None) -> object:
    for p in (path or "").split("."):
        if p:
            doc = doc.get(p) if isinstance(doc, dict) else None
    return doc


def pages(url: str, paging: dict, fetch: Fetch, most_pages: int = 10_000) -> Iterator[list]:
    """The items of each page. paging: {type: none, offset, cursor or link, items, size, cursor, param, limit_param}."""
    kind, items = paging.get("type", "none"), paging.get("items")
    params, size = {}, paging.get("size", 100)
    if kind == "offset":
        params = {paging.get("param", "offset"): 0, paging.get("limit_param", "limit"): size}
    for _ in range(most_pages):
        doc, headers = fetch(url, dict(params))
        got = _at(doc, items)
        got = got if isinstance(got, list) else [] if got is None else [got]
        if got:
            yield got
        if kind == "offset" and len(got) >= size:
            params[paging.get("param", "offset")] += size
        elif kind == "cursor" and (nxt := _at(doc, paging.get("cursor", "next"))):
            params = {paging.get("param", "cursor"): nxt}
        elif kind == "link" and (nxt := headers.get("next")):
            url, params = nxt, {}
        else:
            return
    raise ValueError(f"Over {most_pages} pages")


def read_rest(spark: SparkSession, url: str, paging: dict, fetch: Fetch, schema: str | None = None) -> DataFrame:
    """The items as rows; with ``schema`` parsed.

    One service answers one caller, so paging runs on the driver; every CHUNK_ITEMS items
    are written to the shared folder, so that it never holds more than that and a page.
    """
    scratch, parts, held = Scratch(spark, "rest"), [], []
    for p in pages(url, paging, fetch):
        held += [(json.dumps(x),) for x in p]
        if len(held) >= CHUNK_ITEMS:
            parts.append(scratch.write(local_rows(spark, held, "value string")))
            held = []
    df = reduce(DataFrame.unionByName, [*parts, local_rows(spark, held, "value string")])
    if schema is None:
        return df
    return df.select(F.from_json("value", schema).alias("v")).select("v.*")
