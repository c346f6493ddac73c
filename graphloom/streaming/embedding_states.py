"""The states of embeddings as a stream (rows I8, S4).

Events say that an element was seen with a content hash, that a vector of a
hash was stored, or that the element is gone. Each element's state is kept
between batches: stale (no vector of its text), fresh, or orphan (a vector
without an element). A change of state is a row, which
``KeyedTable.sink`` puts into the embedding_state table.

Events of one element are taken in the order of their time; of one time removals come last.
Defined results: events without a name are passed over, unknown events change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seen_hash string, stored_hash string, state string, at long"
OUT = "qualified_name string, content_hash string, state string, updated_at long"
ORDER = {"seen": 0, "embedded": 1, "removed": 2}


def state_of(seen: str | None, stored: str | None) -> str:
    """stale, fresh, orphan, or absent."""
    if seen is None:
        return "absent" if stored is None else "orphan"
    return "fresh" if seen == stored else "stale"


def step(before: tuple[str | None, str | None], event: str, content_hash: str | None) -> tuple[str | None, str | None]:
    """What is known of an element (the hash that it has, the hash of its vector) after an event."""
    seen, stored = before
    if event == "seen":
        return content_hash, stored
    if event == "embedded":
        return seen, content_hash
    if event == "removed":
        return None, stored
    return before


def _change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, stored, was, at = state.get if state.exists else (None, None, "absent", 0)
    rows = pd.concat(list(batches))
    rows = rows.assign(place=rows["event"].map(ORDER).fillna(3)).sort_values(["at", "place", "content_hash"], kind="stable")
    for event, found, when in zip(rows["event"], rows["content_hash"], rows["at"], strict=True):
        seen, stored = step((seen, stored), event, None if pd.isna(found) else found)
        at = max(at, int(when))
    now = state_of(seen, stored)
    state.update((seen, stored, now, at))
    if now != was:
        yield pd.DataFrame({"qualified_name": [key[0]], "content_hash": [seen or stored or ""], "state": [now], "updated_at": [at]})


def embedding_states(events: DataFrame) -> DataFrame:
    """A stream of events (qualified_name, event, content_hash, at) -> the changes of state, one row for each element and batch at most."""
    known = events.where("qualified_name IS NOT NULL AND event IS NOT NULL").select("qualified_name", "event", "content_hash", F.coalesce("at", F.lit(0)).cast("long").alias("at"))
    return known.groupBy("qualified_name").applyInPandasWithState(_change, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
