"""Episode reads: keyset pages, recent rows and the case timeline."""

from __future__ import annotations

import base64
import binascii
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.scalars import utc_iso

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
LOCATION_SCOPE = "location:read"


def encode_cursor(start_at: str, episode_id: str) -> str:
    raw = f"{start_at}|{episode_id}".encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    """The position after which a page starts; anything unreadable is refused."""
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
        start_at, _, episode_id = text.partition("|")
        datetime.fromisoformat(start_at.replace("Z", "+00:00"))
    except (binascii.Error, UnicodeDecodeError, ValueError) as error:
        raise ValueError("the cursor is not valid") from error
    if not episode_id:
        raise ValueError("the cursor is not valid")
    return start_at, episode_id


def page_rows(
    episodes: DataFrame,
    scopes: tuple[str, ...] = (),
    cursor: str | None = None,
    limit: int | None = None,
    state: str | None = None,
    device_ref: str | None = None,
    cell: str | None = None,
) -> DataFrame:
    """One page in ``(start_at, episode_id)`` order plus one probe row.

    A cell filter without the location scope is refused rather than ignored.  The cursor is a range
    predicate on the sort key, so it reaches the scan and the page is a bounded top-n.
    """
    if cell is not None and LOCATION_SCOPE not in scopes:
        raise PermissionError(f"this filter needs the {LOCATION_SCOPE} scope")
    rows = episodes
    for column, wanted in (("state", state), ("device_ref", device_ref), ("cell", cell)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if cursor is not None:
        start_at, episode_id = decode_cursor(cursor)
        at = F.lit(start_at).cast("timestamp")
        rows = rows.filter(
            (F.col("start_at") > at)
            | ((F.col("start_at") == at) & (F.col("episode_id") > episode_id))
        )
    size = min(max(DEFAULT_LIMIT if limit is None else limit, 1), MAX_LIMIT)
    return rows.orderBy("start_at", "episode_id").limit(size + 1)


def list_episodes(episodes: DataFrame, limit: int | None = None, **request) -> tuple[list, str | None]:
    """A page of rows and the cursor of the next page; at most 201 rows reach the driver."""
    size = min(max(DEFAULT_LIMIT if limit is None else limit, 1), MAX_LIMIT)
    found = page_rows(episodes, limit=limit, **request).withColumn("_iso", utc_iso(F.col("start_at"))).collect()
    items = found[:size]
    following = None
    if len(found) > size:
        following = encode_cursor(items[-1]["_iso"], items[-1]["episode_id"])
    return items, following


def recent(episodes: DataFrame, count: int = 5) -> DataFrame:
    return episodes.orderBy(F.desc("start_at"), "episode_id").limit(count)


def timeline(versions: DataFrame, actions: DataFrame) -> DataFrame:
    """Version transitions and recorded actions of every episode as one history."""
    opened = F.when(F.col("supersedes").isNull(), F.lit("opened as")).otherwise(F.lit("to"))
    transitions = versions.select(
        "episode_id",
        "at",
        F.lit("transition").alias("kind"),
        F.concat(
            opened, F.lit(" "), "state", F.lit(" ("), "cause", F.lit("): "), "reason"
        ).alias("summary"),
        "actor",
    )
    recorded = actions.select(
        "episode_id",
        "at",
        F.lit("action").alias("kind"),
        F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(": "), "reference").alias("summary"),
        F.lit("recorded action").alias("actor"),
    )
    return transitions.unionByName(recorded)


def tenant_rows(rows: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant; without a tenant there is nothing to see."""
    if not tenant_id:
        return rows.filter(F.lit(False))
    return rows.filter(F.col("tenant_id") == tenant_id)
