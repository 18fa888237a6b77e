"""Ledger events as a stream: running budgets, and reservations decided as they arrive.

An extension: the ledgers replayed in batch are append-only event tables, and a stream of the same events gives
the same decisions when each workflow's events come in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators import ledger


def windowed_use(events: DataFrame, width: str = "1 day", late: str = "1 hour", ts: str = "ts", key: str = "role") -> DataFrame:
    """(start, key, n): events per window and key; those later than the watermark allows are left out."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), key, "n")


def _packed(state: dict) -> str:
    plain = state | {"last": [[*k, v] for k, v in state["last"].items()]}
    return json.dumps(plain | {k: [[*key, sorted(v)] for key, v in state[k].items()] for k in ("candidates", "judges")})


def _unpacked(text: str) -> dict:
    state = json.loads(text)
    state["last"] = {(a, b): v for a, b, v in state["last"]}
    for k in ("candidates", "judges"):
        state[k] = {(role, p): set(v) for role, p, v in state[k]}
    return state


def decide_stream(events: DataFrame, budget: int = 8, mode: str = "standard") -> DataFrame:
    """The decisions of :func:`loomtext.operators.ledger.replay` over a stream; state is one workflow's ledger."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get[0]) if state.exists else ledger.fresh_state(budget, mode)
        rows, out = pd.concat(list(batches)).sort_values("seq").to_dict("records"), []
        for row in rows:
            row = {k: None if v is None or v != v else v for k, v in row.items()}
            decision, charged = ledger.step(held, row)
            out.append((row["workflow"], row["seq"], decision, charged, held["used"]))
        state.update((_packed(held),))
        yield pd.DataFrame(out, columns=["workflow", "seq", "decision", "charged", "used"])

    return events.groupBy("workflow").applyInPandasWithState(run, ledger.REPLAY_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)
