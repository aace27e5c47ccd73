"""The alert life cycle on a stream: which alerts open and which are resolved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.schema import ERROR_RATE_ALERT
from faultline.streaming.monitor import keep_state_on_disk

_STATE = T.StructType([T.StructField("opened_at", T.TimestampType())])
_EVENTS = [
    T.StructField("change", T.StringType()),
    T.StructField("opened_at", T.TimestampType()),
    T.StructField("resolved_at", T.TimestampType()),
]

class _LifeCycle(StatefulProcessor):
    """Remembers, per key, when its open alert began; nothing else."""

    def __init__(self, keys: Sequence[str], threshold: float):
        self.keys, self.threshold = list(keys), threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        opened = pd.Timestamp(held[0]) if held else None
        windows = pd.concat([r[["window_start", "error_rate"]] for r in rows])
        changes = []
        for at, rate in windows.sort_values("window_start").itertuples(index=False):
            if rate > self.threshold and opened is None:
                opened = at
                changes.append(("opened", opened, pd.NaT))
            elif rate <= self.threshold and opened is not None:
                changes.append(("resolved", opened, at))
                opened = None
        if opened is not None:
            self.state.update((opened.to_pydatetime(),))
        elif held:
            self.state.clear()
        found = pd.DataFrame(changes, columns=["change", "opened_at", "resolved_at"])
        for at, name in enumerate(self.keys):
            found.insert(at, name, key[at])
        found["opened_at"] = pd.to_datetime(found["opened_at"])
        found["resolved_at"] = pd.to_datetime(found["resolved_at"])
        yield found

    def close(self) -> None:
        pass


def alert_changes(
    rates: DataFrame, keys: Sequence[str] = ("service",), threshold: float = ERROR_RATE_ALERT
) -> DataFrame:
    """A row when an alert opens and one when it is resolved.

    ``rates`` is a stream of closed windows (append output with a watermark, or
    the files such a stream wrote): windows then come in time order over the
    batches. One timestamp of state is kept per key, in RocksDB.
    """
    keep_state_on_disk(rates.sparkSession)
    wanted = rates.select(*keys, "window_start", "error_rate")
    fields = [wanted.schema[k] for k in keys] + _EVENTS
    return wanted.groupBy(*keys).transformWithStateInPandas(
        _LifeCycle(keys, threshold), T.StructType(fields), "Append", "None"
    )
