"""Sliding-window admission over a stream: the accepted times of each key are its state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_id long, accepted boolean"


def admit(events: DataFrame, most: int = 20, window_seconds: int = 600, watermark: str = "1 hour") -> DataFrame:
    """events: user_id, event_id, ts (timestamp). Rejected events don't count against the limit. Events of a key are taken
    in time order within a micro-batch; state is dropped once the watermark has passed a window beyond its last event."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for t, event in zip((rows.ts.astype("int64") // 1000).tolist(), rows.event_id.tolist(), strict=True):
            live = [x for x in live if x > t - window_seconds * 1_000_000]
            ok = len(live) < most
            if ok:
                live.append(t)
            out.append((key[0], event, ok))
        state.update((live,))
        if live:
            state.setTimeoutTimestamp(max(live[-1] // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted"])

    keyed = events.withWatermark("ts", watermark).groupBy("user_id")
    return keyed.applyInPandasWithState(step, OUTPUT, "live array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(comments: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Comments (file, line, ts) of a stream, each place once."""
    return comments.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["file", "line"])


def only_requests(raw: DataFrame) -> DataFrame:
    """Webhook bodies (JSON in `value`) that ask for a review: a pull request opened, updated, reopened or ready, not a draft."""
    from pyspark.sql import functions as F

    schema = "action string, pull_request struct<number:long,draft:boolean,head:struct<sha:string>>, repository struct<full_name:string>, installation struct<id:long>"
    e = raw.select(F.from_json("value", schema).alias("e")).select("e.*")
    wanted = F.col("action").isin("opened", "synchronize", "reopened", "ready_for_review") & ~F.coalesce("pull_request.draft", F.lit(False))
    return e.filter(wanted).select(F.col("installation.id").alias("installation"), F.col("repository.full_name").alias("repository"), F.col("pull_request.number").alias("number"), F.col("pull_request.head.sha").alias("sha"))


def within_size(requests: DataFrame, sizes: DataFrame, most_bytes: int = 500_000_000) -> DataFrame:
    """requests: repository; sizes: repository, bytes. Only repositories of a known size within the limit are reviewed."""
    return requests.join(sizes.filter(F.col("bytes") <= most_bytes).select("repository").distinct(), "repository", "left_semi")


def signed(bodies: DataFrame, secret: str) -> DataFrame:
    """bodies: body, signature (`sha256=` and lowercase hex). Those that the secret signs."""
    import hashlib
    import hmac

    key = secret.encode()

    @F.pandas_udf("boolean")
    def genuine(body: pd.Series, signature: pd.Series) -> pd.Series:
        want = ["sha256=" + hmac.new(key, (b or "").encode(), hashlib.sha256).hexdigest() for b in body]
        return pd.Series([hmac.compare_digest(w, s or "") for w, s in zip(want, signature, strict=True)])

    return bodies.filter(genuine("body", "signature"))
