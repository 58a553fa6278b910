"""Sessions that expire, their ceilings, and the state of jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_SECONDS = 3600
MAX_FILES, MAX_BYTES, MAX_CHUNKS = 20, 50 * 1024 * 1024, 4000


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", ttl: int = TTL_SECONDS) -> DataFrame:
    """user, started, last_seen, n_events: activity with gaps of at most ``ttl`` seconds, in batch.

    A gap of exactly ttl keeps the session. Rows without user or time are left
    out. Activity is put together within each user's days first, so that what
    is sorted per user is stretches and not events, however active the user is.
    """
    e = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("user"), F.col(ts).alias("t"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    e = e.select("user", "t", F.col("at").alias("since"), F.col("at").alias("until"), F.lit(1).alias("n"), F.floor(F.col("at") / 86_400_000_000).alias("day"))

    def joined(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("since", "until")
        opens = F.when(F.col("since") - F.lag("until").over(w) > ttl * 1_000_000, 1).otherwise(0)
        marked = df.withColumn("__o", opens).withColumn("__n", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        first = "started" if "started" in df.columns else "t"
        last = "last_seen" if "last_seen" in df.columns else "t"
        return marked.groupBy(*keys, "__n").agg(F.min(first).alias("started"), F.max(last).alias("last_seen"), F.min("since").alias("since"), F.max("until").alias("until"), F.sum("n").alias("n")).drop("__n")

    return joined(joined(e, "user", "day"), "user").select("user", "started", "last_seen", F.col("n").alias("n_events"))


def session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", ttl: int = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """The same over a stream, by event time with a watermark; times without zone are taken as UTC."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.col(user).alias("user"), F.session_window(ts, f"{ttl} seconds")).agg(F.count("*").alias("n_events")).select("user", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "n_events")


def expired(last_seen: DataFrame, now, ttl: int = TTL_SECONDS) -> DataFrame:
    """Sessions whose last activity is more than ``ttl`` seconds before now."""
    return last_seen.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp")) > ttl)


def accepted_uploads(uploads: DataFrame, order: str = "uploaded_at", max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Uploads with ``accepted``: whether the session's ceilings on files, bytes and passages still hold with it.

    A content uploaded again to the same session counts nothing. A file that is
    refused does not count for the later ones of its session if it alone breaks
    a ceiling.
    """
    w = Window.partitionBy("session_id").orderBy(order, "digest")
    first = F.row_number().over(Window.partitionBy("session_id", "digest").orderBy(order)) == 1
    fits = (F.col("n_bytes") <= max_bytes) & (F.col("n_chunks") <= max_chunks) & (F.col("n_bytes") > 0)
    u = uploads.withColumn("__first", first).withColumn("__counts", F.col("__first") & fits)
    run = lambda c: F.sum(F.when(F.col("__counts"), c).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ok = (run(F.lit(1)) <= max_files) & (run(F.col("n_bytes")) <= max_bytes) & (run(F.col("n_chunks")) <= max_chunks)
    return u.withColumn("accepted", fits & (ok | ~F.col("__first"))).drop("__first", "__counts")


def last_status(changes: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """key, value, ts: the last value of every key; aggregated map-side, no sort."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


# The states of a job and those that may follow.
NEXT_STATES = {"running": ["awaiting_review", "completed", "failed"], "awaiting_review": ["running", "completed", "failed"], "completed": [], "failed": []}


def illegal_changes(changes: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """Changes of status that may not follow the one before; a first status must be 'running'."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(ts, tie))
    follows = F.lit(False)
    for state, after in NEXT_STATES.items():
        follows = follows | ((F.col("before") == state) & F.col(value).isin(state, *after))
    return changes.withColumn("before", before).where(~F.coalesce(F.when(F.col("before").isNull(), F.col(value) == "running").otherwise(follows), F.lit(False)))


@dataclass
class SessionRegistry:
    """Private frames per session, never joined into the archive's; reaped by time of last use."""

    ttl: int = TTL_SECONDS
    frames: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    seen: dict[str, float] = field(default_factory=dict)
    threads: dict[str, str] = field(default_factory=dict)

    def get_or_create(self, session_id: str, now: float) -> dict[str, DataFrame]:
        self.reap(now)
        self.seen[session_id] = now
        return self.frames.setdefault(session_id, {})

    def add(self, session_id: str, name: str, df: DataFrame, now: float) -> None:
        own = self.get_or_create(session_id, now)
        own[name] = own[name].unionByName(df, allowMissingColumns=True) if name in own else df

    def bind(self, thread_id: str, session_id: str) -> None:
        self.threads[thread_id] = session_id

    def end(self, session_id: str) -> list[str]:
        """Forget a session; returns its threads, whose rows are to be scrubbed."""
        self.frames.pop(session_id, None)
        self.seen.pop(session_id, None)
        gone = [t for t, s in self.threads.items() if s == session_id]
        for t in gone:
            del self.threads[t]
        return gone

    def reap(self, now: float) -> list[str]:
        old = [s for s, t in self.seen.items() if now - t > self.ttl]
        for s in old:
            self.end(s)
        return old
