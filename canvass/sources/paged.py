"""Paged sources as batch readers: a docket is one task, which yields its records page by page.

The client is given: a function from a path and parameters to a ``Response``. It is sent to the executors, so it must be
picklable; tests give one that reads from a dictionary. Windows and offsets of one docket follow each other, as each
page's place depends on the one before; dockets run side by side.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame

#: Limits of the sources (fixed values).
REGULATIONS_PAGE, REGULATIONS_PAGES, ECFS_PAGE, ECFS_LAST_OFFSET = 250, 20, 250, 9999
#: Attempts at a page, and seconds to wait between them: doubled each time within these bounds (fixed values).
ATTEMPTS, WAIT_LEAST, WAIT_MOST = 5, 2.0, 60.0


class StalledCursor(RuntimeError):
    """More records share a timestamp than a window holds, so the next window would be the same."""


class OffsetCeiling(RuntimeError):
    """The source serves no rows beyond an offset; ask for shorter ranges of dates."""


class Unavailable(RuntimeError):
    """The source answered with an error, after all attempts if it was one to try again."""


@dataclass
class Response:
    """A status, a body (decoded JSON, or text) and lower-case headers."""

    status: int
    body: object
    headers: dict[str, str] = field(default_factory=dict)


Client = Callable[[str, dict], Response]


def fetched(client: Client, path: str, params: dict, sleep: Callable[[float], None] = time.sleep) -> Response:
    """A successful response; 429 and 5xx are tried again with growing waits, other errors are not."""
    wait = WAIT_LEAST
    for attempt in range(1, ATTEMPTS + 1):
        response = client(path, params)
        if 200 <= response.status < 300:
            return response
        if response.status != 429 and response.status < 500 or attempt == ATTEMPTS:
            break
        sleep(wait)
        wait = min(2 * wait, WAIT_MOST)
    raise Unavailable(f"{response.status} on {path}")


def eastern(moment: str) -> str:
    """An ISO moment as the source's cursor has it: US Eastern time without an offset; other text is left as it is."""
    try:
        at = datetime.fromisoformat(moment.replace("Z", "+00:00"))
    except ValueError:
        return moment
    return at.astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%d %H:%M:%S")


def regulations_records(client: Client, docket_id: str, page_size: int = REGULATIONS_PAGE, sleep=time.sleep) -> Iterator[dict]:
    """All records of a docket, oldest change first. A full window is followed by one from its last change on, so records at
    its edge come twice; merging by key takes care of them.
    """
    cursor = None
    while True:
        params = {"filter[docketId]": docket_id, "sort": "lastModifiedDate,documentId", "page[size]": page_size}
        if cursor:
            params["filter[lastModifiedDate][ge]"] = eastern(cursor)
        last = None
        for page in range(1, REGULATIONS_PAGES + 1):
            body = fetched(client, "/comments", params | {"page[number]": page}, sleep).body
            records = body.get("data") or []
            yield from records
            last = next((m for r in reversed(records) if (m := (r.get("attributes") or {}).get("lastModifiedDate"))), last)
            if not ((body.get("meta") or {}).get("hasNextPage") or (body.get("links") or {}).get("next")):
                return
        if last is None or last == cursor:
            raise StalledCursor(f"{docket_id}: over {REGULATIONS_PAGES * page_size} records were changed at {last}")
        cursor = last


def ecfs_filings(client: Client, docket_id: str, start: str | None = None, end: str | None = None, page_size: int = ECFS_PAGE, sleep=time.sleep, pause: float = 0.0) -> Iterator[dict]:
    """All filings of a proceeding in a range of dates, by offset; ``pause`` seconds lie between pages."""
    params = {"proceedings.name": docket_id, "limit": page_size, "sort": "date_received,ASC"}
    if start or end:
        params["q"] = f"date_received:[{f'{start}T00:00:00Z' if start else '*'} TO {f'{end}T23:59:59Z' if end else '*'}]"
    offset = 0
    while True:
        if offset + page_size > ECFS_LAST_OFFSET + 1:
            raise OffsetCeiling(f"{docket_id}: no rows are served beyond offset {ECFS_LAST_OFFSET}")
        if offset and pause:
            sleep(pause)
        response = fetched(client, "/filings", params | {"offset": offset}, sleep)
        if isinstance(response.body, str) or response.headers.get("content-type", "").startswith("text/"):
            raise OffsetCeiling(f"{docket_id}: a text instead of rows at offset {offset}: {str(response.body)[:200]!r}")
        filings = response.body.get("filing") or []
        yield from filings
        if len(filings) < page_size:
            return
        offset += page_size


def read_dockets(dockets: DataFrame, client: Client) -> DataFrame:
    """``docket_id, json`` of every record of the dockets (``docket_id, source`` and optionally ``start_date, end_date``).

    A docket is a task's work and its records are passed on page by page. Null ids and unknown sources raise an error.
    """
    dates = [c for c in ("start_date", "end_date") if c in dockets.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                name, source = row["docket_id"], row["source"]
                if source not in ("regulations_gov", "ecfs") or not name:
                    raise ValueError(f"{name}: unknown source {source}")
                records = regulations_records(client, name) if source == "regulations_gov" else ecfs_filings(client, name, *(row.get(c) for c in ("start_date", "end_date")))
                page: list[str] = []
                for record in records:
                    page.append(json.dumps(record))
                    if len(page) >= REGULATIONS_PAGE:
                        yield pd.DataFrame({"docket_id": name, "json": page})
                        page = []
                if page:
                    yield pd.DataFrame({"docket_id": name, "json": page})

    chosen = dockets.select("docket_id", "source", *dates)
    return chosen.repartition("docket_id").mapInPandas(run, "docket_id string, json string")


def fetch_details(comments: DataFrame, client: Client, sleep=time.sleep) -> DataFrame:
    """``comment_id, docket_id, enrichment_status, enrichment_error, raw_detail_json``: the detail of every comment, with attachments.

    A comment whose detail can't be had is ``failed`` with the error, and the others go on. Repeated ids are fetched once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = []
            for name in x["comment_id"]:
                try:
                    found.append(("enriched", None, json.dumps(fetched(client, f"/comments/{name}", {"include": "attachments"}, sleep).body)))
                except Unavailable as e:
                    found.append(("failed", str(e), None))
            yield x.assign(**{c: [f[i] for f in found] for i, c in enumerate(("enrichment_status", "enrichment_error", "raw_detail_json"))})

    rows = comments.select("comment_id", "docket_id").where("comment_id is not null").dropDuplicates(["comment_id"])
    return rows.mapInPandas(run, "comment_id string, docket_id string, enrichment_status string, enrichment_error string, raw_detail_json string")
