"""Append-only ledgers: the last row wins, resume, paid work, spend states and run events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrashift.config import MICRO

HELD = ("reserved", "uncertain")  # states whose worst case still counts against the cap
ACTIVE = ("queued", "running")


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: a mergeable maximum, so a key that fills the table costs one row for each task."""
    rest = [c for c in rows.columns if c != key and c not in order]
    packed = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return packed.select(key, *(F.col(f"_r.{c}").alias(c) for c in [*order, *rest])).select(rows.columns)


def remaining(tiles: DataFrame, done: DataFrame, key: str = "tile_id") -> DataFrame:
    """What a resumed run still has to do."""
    return tiles.join(done.select(key).distinct(), key, "left_anti")


def resume_state(done: DataFrame) -> DataFrame:
    return done.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("vlm_called").alias("calls"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"),
    )


def paid_rows(rows: DataFrame) -> int:
    return rows.where("vlm_called").count()


def refuse_to_discard(rows: DataFrame, overwrite: bool = False) -> None:
    """Raise rather than delete a ledger that holds paid calls."""
    if not overwrite and (n := paid_rows(rows)):
        raise RuntimeError(f"{n} paid calls would be lost; resume, or overwrite on purpose")


def remaining_budget(cap: int | None, calls: int) -> int | None:
    return None if cap is None else max(0, cap - calls)


def same_selection(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: whether two selections hold the same values, and how many differ on each side."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    only_a, only_b = left.join(right, column, "left_anti"), right.join(left, column, "left_anti")
    both = only_a.select(F.lit("a").alias("side")).unionAll(only_b.select(F.lit("b").alias("side")))
    got = both.agg(F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"))
    return got.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def numbered(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Events with seq 1, 2, ... within their run."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy(*order)))


def next_seq(events: DataFrame, run: str, seq: str = "seq") -> DataFrame:
    return events.groupBy(run).agg((F.max(seq) + 1).alias("next_seq"))


def after_cursor(events: DataFrame, run: str, value: object, after: int, limit: int | None = None) -> DataFrame:
    got = events.where((F.col(run) == value) & (F.col("seq") > after)).orderBy("seq")
    return got if limit is None else got.limit(limit)


def recent(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def recovered(runs: DataFrame) -> DataFrame:
    """Runs that a stopped process left active are failed."""
    return runs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "failed").otherwise(F.col("status")))


def state_totals(reservations: DataFrame, cap_micro: int) -> DataFrame:
    """settled, outstanding and available micro-dollars, with the number of reservations in each state."""
    a = reservations.agg(
        F.coalesce(F.sum("settled_micro"), F.lit(0)).alias("settled_micro"),
        F.coalesce(F.sum(F.when(F.col("state").isin(*HELD), F.col("reserved_micro"))), F.lit(0)).alias("outstanding_micro"),
        *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("reserved", "settled", "uncertain", "released")),
    )
    used = F.col("settled_micro") + F.col("outstanding_micro")
    return a.withColumn("available_micro", F.greatest(F.lit(0), F.lit(cap_micro) - used).cast("bigint"))


def running_cap(requests: DataFrame, group: str, order: list[str], amount: str, cap: int) -> DataFrame:
    """Requests in order with the running total of their group and whether it is still within the cap."""
    over = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return requests.withColumn("running", F.sum(amount).over(over)).withColumn("within_cap", F.col("running") <= cap)


class SpendLedger:
    """Quote, reserve, settle: decisions are serialised in one writer, every event is an appended row.

    A cap needs one transaction at a time, which is a writer's business and
    not a query's; the events it appends are what the queries above read. It
    lives in memory; ``streaming.spending`` decides a durable log of the same
    events and survives restarts.
    """

    def __init__(self, cap_usd: float, ttl_s: float = 300.0):
        self.cap = round(cap_usd * MICRO)
        self.ttl = ttl_s
        self.quotes: dict[str, dict] = {}
        self.reservations: dict[str, dict] = {}
        self.events: list[tuple] = []

    def _note(self, at: float, kind: str, ident: str, micro: int) -> None:
        self.events.append((len(self.events) + 1, at, kind, ident, micro))

    def used(self) -> int:
        return sum(r["settled"] + (r["reserved"] if r["state"] in HELD else 0) for r in self.reservations.values())

    def quote(self, fingerprint: str, worst_case_micro: int, now: float) -> str:
        ident = uuid.uuid4().hex
        self.quotes[ident] = {"fingerprint": fingerprint, "micro": worst_case_micro, "until": now + self.ttl, "used": False}
        self._note(now, "quoted", ident, worst_case_micro)
        return ident

    def reserve(self, quote_id: str, fingerprint: str, now: float) -> str:
        """Use a quote once, for the request that it was given for, within its time and the cap."""
        q = self.quotes.get(quote_id)
        if q is None or q["used"] or now > q["until"] or q["fingerprint"] != fingerprint:
            raise PermissionError("the quote is unknown, used, too old or for another request")
        if self.used() + q["micro"] > self.cap:
            raise PermissionError("the cap would be exceeded")
        q["used"] = True
        ident = uuid.uuid4().hex
        self.reservations[ident] = {"reserved": q["micro"], "settled": 0, "state": "reserved"}
        self._note(now, "reserved", ident, q["micro"])
        return ident

    def _move(self, ident: str, state: str, settled: int, now: float) -> None:
        r = self.reservations[ident]
        if r["state"] not in HELD:
            raise ValueError(f"a {r['state']} reservation can't be {state}")
        r["state"], r["settled"] = state, settled
        self._note(now, state, ident, settled)

    def settle(self, ident: str, actual_micro: int, now: float) -> None:
        self._move(ident, "settled", actual_micro, now)

    def uncertain(self, ident: str, now: float) -> None:
        self._move(ident, "uncertain", 0, now)

    def release(self, ident: str, now: float) -> None:
        self._move(ident, "released", 0, now)
