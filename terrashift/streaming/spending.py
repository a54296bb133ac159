"""Spending under a hard cap as a stream: quotes that expire, reservations admitted greedily, holds that are settled or given back.

The log has one row for each event of a ``session``: quote, reserve, settle,
uncertain or release. State is kept by Spark, the sessions of a shard in one
row, and survives a restart from the checkpoint; nothing is held on the driver. A quote can be
used once, for the request that it was given for, until it expires; a timer
then forgets it, so state does not grow with the number of quotes. A
reservation is admitted if what is settled and what is held, with it, stay
within the cap; one that is refused holds nothing, so a smaller one behind it
may still be admitted. An uncertain reservation keeps its hold. An event
without an amount counts as 0, one without a session is left out.

A session's events must come in the order of their time, as one writer
appends them; within a batch they are sorted. Where files of the log overlap
in time, ``delay`` must be as long as the overlap: what is older than the
watermark is late and left out. Two sessions never meet, so a cap over
everything is one session and one task's work by nature.

Sessions are dealt into ``shards`` by a hash. A shard's state goes to its task
and back with its rows, once a batch: a call to the state store for each event,
or a call to Python for each session, costs many times the decisions. A task
holds a shard's events of a batch and its state, so shards grow with the log;
their number can't change while a checkpoint is in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrashift.streaming.events import drain

LOG = "session bigint, event_id bigint, ts timestamp, kind string, ref bigint, fingerprint string, micro bigint"
DECISIONS = "session bigint, event_id bigint, kind string, decision string, settled_micro bigint, held_micro bigint"
STATE = """sessions array<bigint>, settled array<bigint>,
    quoted_by array<bigint>, quotes array<bigint>, fingerprints array<string>, quoted array<bigint>, until array<bigint>, used array<boolean>,
    held_by array<bigint>, holds array<bigint>, held array<bigint>"""
EVENT = ["session", "at", "event_id", "kind", "has_ref", "ref", "fingerprint", "micro"]
SHARDS = 256
TTL_S = 300.0  # fixed value: how long a quote lives
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Account:
    """A session: money settled and held, quotes (fingerprint, micro, until, used) and holds."""

    def __init__(self, settled: int = 0):
        self.settled, self.held = settled, 0
        self.quotes: dict[int, tuple[str | None, int, int, bool]] = {}
        self.holds: dict[int, int] = {}

    def hold(self, ident: int, micro: int) -> None:
        self.holds[ident] = micro
        self.held += micro


class Spending:
    """Decides the events of a shard's sessions in order; the outcome of each and the session's money settled and held after it."""

    def __init__(self, cap_micro: int, ttl_s: float):
        self.cap, self.ttl = cap_micro, int(ttl_s * 1_000_000)

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accounts = _accounts(state.get) if state.exists else {}
        out = []
        if not state.hasTimedOut:
            for session, *event in sorted(e for rows in batches for e in zip(*(rows[c].tolist() for c in EVENT))):
                account = accounts.setdefault(session, Account())
                said = self._decide(account, *event)
                out.append((session, event[1], event[2], said, account.settled, account.held))
        passed = state.getCurrentWatermarkMs()
        for account in accounts.values():
            account.quotes = {k: q for k, q in account.quotes.items() if q[2] >= passed * 1000}
        state.update(_packed(accounts))
        if ends := [q[2] for account in accounts.values() for q in account.quotes.values()]:
            state.setTimeoutTimestamp(max(passed, min(ends) // 1000) + 1)
        yield _frame(out)

    def _decide(self, account: Account, now: int, ident: int, kind: str, has_ref: bool, ref: int, fingerprint: str | None, micro: int) -> str:
        if kind == "quote":
            account.quotes[ident] = (fingerprint, micro, now + self.ttl, False)
            return "quoted"
        if kind == "reserve":
            if not has_ref or ref not in account.quotes or now > (quote := account.quotes[ref])[2]:
                return "refused: no live quote"
            given, micro, until, used = quote
            if used:
                return "refused: already used"
            if given != fingerprint:
                return "refused: another request"
            if account.settled + account.held + micro > self.cap:
                return "refused: over the cap"
            account.quotes[ref] = (given, micro, until, True)
            account.hold(ident, micro)
            return "reserved"
        if not has_ref or ref not in account.holds:
            return "refused: no such hold"
        if kind == "uncertain":
            return "uncertain"
        account.held -= account.holds.pop(ref)
        if kind == "settle":
            account.settled += max(0, micro)
            return "settled"
        return "released"


def _accounts(state: tuple) -> dict[int, Account]:
    """The sessions of a row of STATE."""
    sessions, settled, quoted_by, *quotes, held_by, holds, held = state
    accounts = {s: Account(money) for s, money in zip(sessions, settled)}
    for session, ident, *quote in zip(quoted_by, *quotes):
        accounts[session].quotes[ident] = tuple(quote)
    for session, ident, micro in zip(held_by, holds, held):
        accounts[session].hold(ident, micro)
    return accounts


def _packed(accounts: dict[int, Account]) -> tuple:
    """The sessions as a row of STATE."""
    money = [(s, a.settled) for s, a in accounts.items()]
    quotes = [(s, k, *q) for s, a in accounts.items() for k, q in a.quotes.items()]
    holds = [(s, k, micro) for s, a in accounts.items() for k, micro in a.holds.items()]
    return tuple([r[k] for r in rows] for rows, width in ((money, 2), (quotes, 6), (holds, 3)) for k in range(width))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of DECISIONS; texts as plain objects, which Arrow takes as one array."""
    names = [c.split() for c in DECISIONS.split(", ")]
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=object if kind == "string" else "int64") for k, (name, kind) in enumerate(names)})


def decisions(log: DataFrame, cap_micro: int, ttl_s: float = TTL_S, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """The stream ``log`` (LOG) as a stream of DECISIONS."""
    zero = F.lit(0).cast("bigint")
    event = {"at": F.unix_micros("ts"), "has_ref": F.col("ref").isNotNull(), "ref": F.coalesce("ref", zero), "micro": F.coalesce("micro", zero)}
    timed = log.where("session is not null").withWatermark("ts", delay).withColumns(event)
    dealt = timed.select(F.pmod(F.xxhash64("session"), F.lit(shards)).alias("shard"), "ts", *EVENT)
    return dealt.groupBy("shard").applyInPandasWithState(Spending(cap_micro, ttl_s), DECISIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """State lives in RocksDB, outside the heap; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def log_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).parquet(path)


def decided(spark: SparkSession, path: str, cap_micro: int, ttl_s: float = TTL_S, max_files: int = 1, checkpoint: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The decisions on everything that a log folder holds now; with a ``checkpoint`` only on what came since its last run."""
    with stateful(spark):
        return drain(decisions(log_stream(spark, path, max_files), cap_micro, ttl_s, delay), "spending", "append", checkpoint)
