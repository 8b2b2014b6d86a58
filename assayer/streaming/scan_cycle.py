"""Scan-cycle state machines on streams: one state a device, kept in the state store.

The session needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "device string, scan_no long, run boolean, write boolean, acc_ms long, started boolean, count long"


class DriveScan(StatefulProcessor):
    """Run latch, one-shot, start delay and edge counter of one device.

    run: sealed in by command with permissive, dropped by stop or a lost interlock.
    write: the scan at which command becomes true. acc_ms: time requested without a
    break, the present scan's included, up to the preset; started: it has been reached.
    count: edges of pulse, cleared by reset, after which a held input counts anew; the
    first scan has none. Scans of a batch are taken in the order of scan_no; a scan that
    is not later than the last one is late and gives no row.
    """

    def __init__(self, preset_ms: int) -> None:
        self.preset_ms = preset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scan", "last long, run boolean, command boolean, acc_ms long, pulse boolean, count long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        last, run, command, acc, pulse, count = known or (None, False, False, 0, None, 0)
        out = []
        for s in pd.concat(list(rows)).sort_values("scan_no").itertuples(index=False):
            if last is not None and s.scan_no <= last:
                continue
            hold = bool(s.interlock) and not s.stop
            run = hold and (run or bool(s.command and s.permissive))
            write = bool(s.command) and not command
            acc = min(self.preset_ms, acc + int(s.elapsed_ms)) if s.command else 0
            on = bool(s.pulse) and not s.reset
            count = 0 if s.reset else count + (on and pulse is False)
            last, command, pulse = int(s.scan_no), bool(s.command), on
            out.append((key[0], last, run, write, acc, bool(s.command) and acc >= self.preset_ms, int(count)))
        if out:
            self.state.update((last, run, command, int(acc), pulse, int(count)))
        yield pd.DataFrame(out, columns=["device", "scan_no", "run", "write", "acc_ms", "started", "count"])

    def close(self) -> None:
        pass


def drive_scans(scans: DataFrame, preset_ms: int) -> DataFrame:
    """OUTPUT rows of a stream of scans.

    scans: device, scan_no, elapsed_ms, command, permissive, stop, interlock, pulse, reset.
    """
    return scans.groupBy("device").transformWithStateInPandas(DriveScan(preset_ms), OUTPUT, "Append", "None")
