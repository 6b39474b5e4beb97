"""Bulk indexing of rows into a search service: actions, requests in chunks, retries with growing waits.

The transport is a function that takes a list of actions and returns their (id, status); it is made on the executor by a factory, so tests and other
services can put in their own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transport = Callable[[list[dict]], list[tuple[str | None, int]]]


class BulkError(RuntimeError):
    """Actions that weren't taken, with their status."""


def _action(op: str, index: str | None, id: Column | str | None, doc: Column | None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    return F.struct(F.lit(op).alias("op_type"), F.lit(index).cast("string").alias("index"), text(id).alias("id"), (F.lit(None).cast("string") if doc is None else F.to_json(doc)).alias("doc"))


def _document(df: DataFrame, but: str | None) -> Column:
    """All columns but the id and those whose names start with _."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != but and not c.startswith("_")])


def index_action(df: DataFrame, id: str | None = None, index: str | None = None) -> DataFrame:
    return df.select(_action("index", index, id, _document(df, id)).alias("a")).select("a.*")


def update_action(df: DataFrame, id: str, index: str | None = None) -> DataFrame:
    return df.select(_action("update", index, id, _document(df, id)).alias("a")).select("a.*")


def delete_action(df: DataFrame, id: str, index: str | None = None) -> DataFrame:
    return df.select(_action("delete", index, id, None).alias("a")).select("a.*")


def _send(actions: list[dict], send: Transport, most: int, first: float, longest: float, ignore_400: bool, sleep=time.sleep) -> list[str | None]:
    done: list[str | None] = []
    left, tries = actions, 0
    while left:
        again, bad = [], []
        for action, (id, status) in zip(left, send(left), strict=True):
            if status < 300:
                done.append(id if id is not None else action["id"])
            elif status == 400:
                if not ignore_400:
                    bad.append((action["id"], status))
            else:
                again.append(action)
        if bad:
            raise BulkError(f"{len(bad)} actions failed: {bad[:3]}")
        if again and tries >= most:
            raise BulkError(f"{len(again)} actions failed after {tries} retries")
        if again:
            sleep(min(longest, first * 2**tries))
        left, tries = again, tries + 1
    return done


def bulk_index(
    actions: DataFrame, transport: Callable[[], Transport], default_index: str | None = None, parallelism: int | None = None, buffer_size: int = 3200, chunk_size: int = 800, max_retries: int = 10,
    initial_backoff: float = 2, max_backoff: float = 600, ignore_400: bool = True, dry_run: bool = False,
) -> DataFrame:
    """(id) of what was taken. Actions without an index go to default_index; without that they are an error. Each buffer is sorted by id and sent in chunks.

    Actions have ids of their own for what must not be written twice: a task that runs again sends its rows again.
    """
    if parallelism:
        actions = actions.repartition(parallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = None if dry_run else transport()
        held: list[dict] = []

        def flush() -> pd.DataFrame:
            held.sort(key=lambda a: a["id"] or "")
            out: list[str | None] = []
            for i in range(0, len(held), chunk_size):
                part = held[i : i + chunk_size]
                out += [a["id"] for a in part] if send is None else _send(part, send, max_retries, initial_backoff, max_backoff, ignore_400)
            held.clear()
            return pd.DataFrame({"id": pd.Series(out, dtype=object)})

        for batch in batches:
            for a in batch.to_dict("records"):
                index = a["index"] or default_index
                if index is None:
                    raise RuntimeError("an action has no index, and there is no default")
                held.append(a | {"index": index})
                if len(held) >= buffer_size:
                    yield flush()
        if held:
            yield flush()

    return actions.select("op_type", "index", "id", "doc").mapInPandas(run, "id string")


def request_body(actions: list[dict]) -> str:
    """The lines of a bulk request."""
    lines = []
    for a in actions:
        meta = {k: v for k, v in (("_index", a["index"]), ("_id", a["id"])) if v is not None}
        lines.append(json.dumps({a["op_type"]: meta}))
        if a["op_type"] != "delete":
            lines.append(f'{{"doc": {a["doc"]}}}' if a["op_type"] == "update" else a["doc"])
    return "\n".join(lines) + "\n"


def http_transport(url: str, timeout: float = 240) -> Callable[[], Transport]:
    """A factory of transports that post to a service's bulk address."""

    def make() -> Transport:
        from urllib.request import Request, urlopen

        def send(actions: list[dict]) -> list[tuple[str | None, int]]:
            with urlopen(Request(url, request_body(actions).encode(), {"Content-Type": "application/x-ndjson"}), timeout=timeout) as r:
                return [(x.get("_id"), x["status"]) for item in json.load(r)["items"] for x in item.values()]

        return send

    return make


def ensure_index(exists: Callable[[str], bool], create: Callable[[str, dict], None], name: str, settings: dict | None = None) -> bool:
    """Creates an index that isn't there; whether it did. Called on the driver."""
    if exists(name):
        return False
    create(name, settings or {})
    return True
