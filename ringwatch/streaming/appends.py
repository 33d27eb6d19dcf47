"""Validation of ledger entries as they arrive: the head of each session is the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ringwatch.operators.ledger import DOMAIN, FIELDS, GENESIS, canonical

#: The state store that keeps such a processor's state (a setting of the session).
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
VERDICT = "session long, seq long, verdict string"


class Appender(StatefulProcessor):
    """Accepts an entry that extends its session's head, and moves the head; refuses any other and says why."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, tail string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, tail = tuple(self.head.get()) if self.head.exists() else (0, GENESIS)
        new = pd.concat(list(rows)).sort_values(["seq", "entry_hash"])
        out = []
        for row in new.to_dict("records"):
            cells = ["" if row[c] is None else str(row[c]) for c in FIELDS[1:]]
            verdict = "accepted"
            if row["seq"] != seq:
                verdict = "seq_gap"
            elif row["prev_hash"] != tail:
                verdict = "prev_hash_mismatch" if seq else "genesis_mismatch"
            elif row["entry_hash"] != canonical([DOMAIN, str(seq), *cells]):
                verdict = "entry_hash_mismatch"
            else:
                seq, tail = seq + 1, row["entry_hash"]
            out.append((key[0], row["seq"], verdict))
        self.head.update((seq, tail))
        yield pd.DataFrame(out, columns=["session", "seq", "verdict"])

    def close(self) -> None:
        pass


def appended(entries: DataFrame) -> DataFrame:
    """A verdict on every entry of a stream (session, the ledger's fields and entry_hash). After a refusal nothing extends the head until the right entry comes."""
    keyed = entries.select("session", *FIELDS, "entry_hash").groupBy("session")
    return keyed.transformWithStateInPandas(statefulProcessor=Appender(), outputStructType=VERDICT, outputMode="append", timeMode="none")
