"""Scan-cycle state machines as window expressions.

Rows are the scans of a device in order. Where a state depends on inputs alone it is a
window function; where it feeds on its own output it is a fold over the device's ordered
scans. A device is one group: its scans follow each other, so its state can't be split.
Inputs are boolean columns without nulls.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


class Scans:
    """The scans of every ``key`` in an order without ties."""

    def __init__(self, key: str, *order: str) -> None:
        self.window = Window.partitionBy(key).orderBy(*order)
        self.upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.key, self.order = key, order

    def previous(self, value: Column, default: object = None) -> Column:
        return F.lag(value, 1, default).over(self.window)

    def one_shot(self, value: Column) -> Column:
        """True on the scan at which ``value`` becomes true."""
        return value & ~F.coalesce(self.previous(value), F.lit(False))

    def latch(self, set_: Column, reset: Column) -> Column:
        """Seal-in latch: true from a scan that sets it up to the next one that resets it; reset wins."""
        last = F.last(F.when(reset, False).when(set_, True), ignorenulls=True).over(self.upto)
        return F.coalesce(last, F.lit(False))

    def island(self, reset: Column) -> Column:
        """Number of resets up to and with this scan."""
        return F.sum(reset.cast("int")).over(self.upto)


def command_run(rows: DataFrame, scans: Scans, command: str, permissive: str, opposite: str, stop: str, interlock: str, name: str = "run") -> DataFrame:
    """Operator run latch: sets on command with permissive and no opposite command,
    holds while the interlock is made and no stop is given."""
    hold = F.col(interlock) & ~F.col(stop)
    return rows.withColumn(name, scans.latch(F.col(command) & F.col(permissive) & ~F.col(opposite) & hold, ~hold))


def mode_write(rows: DataFrame, scans: Scans, inhibit: str, uninhibit: str, mode: str) -> DataFrame:
    """``rows`` plus write and mode_out: one write of bit 2 a rising edge of either command.

    Both commands share the edge, so changing straight from one to the other writes
    nothing; inhibit wins.
    """
    write = scans.one_shot(F.col(inhibit) | F.col(uninhibit))
    rows = rows.withColumn("write", write)
    out = F.when(F.col(inhibit), F.col(mode).bitwiseOR(F.lit(0x0004))).otherwise(F.col(mode).bitwiseAND(F.lit(0xFFFB)))
    return rows.withColumn("mode_out", F.when(F.col("write"), out))


def edge_counter(rows: DataFrame, scans: Scans, up: str, reset: str, preset: int) -> DataFrame:
    """``rows`` plus edge, cv and q of an up counter.

    The first scan has no edge. A reset clears the remembered input, so an input that is
    held counts anew on the first scan after it. q keeps cv >= preset as of the last edge.
    """
    first = F.row_number().over(scans.window) == 1
    held = F.coalesce(scans.previous(F.col(up) & ~F.col(reset)), F.lit(False))
    rows = rows.withColumn("edge", F.col(up) & ~F.col(reset) & ~first & ~held).withColumn("__island", scans.island(F.col(reset)))
    inside = Window.partitionBy(scans.key, "__island").orderBy(*scans.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("cv", F.sum(F.col("edge").cast("long")).over(inside))
    q = F.last(F.when(F.col("edge"), F.col("cv") >= preset), ignorenulls=True).over(inside)
    return rows.withColumn("q", F.coalesce(q, F.lit(False))).drop("__island")


def on_delay(rows: DataFrame, scans: Scans, request: str, elapsed: str, preset: int) -> DataFrame:
    """``rows`` plus acc and done: time requested without a break, the present scan's
    included, up to the preset; a scan without request clears it."""
    rows = rows.withColumn("__island", scans.island(~F.col(request)))
    inside = Window.partitionBy(scans.key, "__island").orderBy(*scans.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acc = F.least(F.lit(preset).cast("long"), F.sum(F.when(F.col(request), F.col(elapsed)).otherwise(0)).over(inside))
    rows = rows.withColumn("acc", acc.cast("long"))
    return rows.withColumn("done", F.col(request) & (F.col("acc") >= preset)).drop("__island")


def retentive_timer(rows: DataFrame, scans: Scans, enable: str, reset: str, elapsed: str, preset: int) -> DataFrame:
    """``rows`` plus et and q: time between scans that are both enabled, kept over breaks.

    A segment starts at its first enabled scan and the falling scan adds nothing. A reset
    clears it; q holds from the preset on until then.
    """
    on = F.col(enable) & ~F.col(reset)
    rows = rows.withColumn("__dt", F.when(on & F.coalesce(scans.previous(on), F.lit(False)), F.col(elapsed)).otherwise(0)).withColumn("__island", scans.island(F.col(reset)))
    inside = Window.partitionBy(scans.key, "__island").orderBy(*scans.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("et", F.least(F.lit(preset).cast("long"), F.sum("__dt").over(inside).cast("long")))
    return rows.withColumn("q", F.col("et") >= preset).drop("__dt", "__island")


def rtc_pulse(rows: DataFrame, key: str, order: Sequence[str], enable: str, clock_ms: str, interval_ms: int) -> DataFrame:
    """key, order columns and pulse of every scan.

    The timer starts at a rising enable and again after each pulse; it pulses once the
    clock is an interval past the start. A null clock is a failure and clears it; a clock
    that goes back gives no pulse. The start depends on the pulses before, so a device's
    scans are sorted in one partition and passed once; only the start is carried along.
    """
    kept = [key, *order]

    def pulses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, start, first = None, None, True
        for b in batches:
            out = []
            for name, on, now in zip(*(b.column(c).to_pylist() for c in (key, "__on", "__now"))):
                if first or name != device:
                    device, start, first = name, None, False
                live = on and now is not None
                pulse = live and start is not None and now - start >= interval_ms
                start = None if not live else now if pulse or start is None else start
                out.append(bool(pulse))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.bool_())], [*kept, "pulse"])

    slim = rows.select(*kept, F.col(enable).alias("__on"), F.col(clock_ms).cast("long").alias("__now"))
    types = StructType([*(slim.schema[c] for c in kept), StructField("pulse", BooleanType())])
    return slim.repartition(key).sortWithinPartitions(*kept).mapInArrow(pulses, types)


def up_down_counter(rows: DataFrame, key: str, order: Sequence[str], up: str, down: str, reset: str, preset: int) -> DataFrame:
    """``rows`` plus cv, done, overflow and underflow of a counter of 32 bits.

    A rising up adds one and a rising down takes one; beyond the least or the greatest
    value the count goes on at the other end, and overflow or underflow is set until a
    reset. On the first scan no input rises; a reset clears the count and the flags and wins over
    both inputs, but the inputs are remembered. done: cv has reached the preset. The count
    is a running sum since the last reset, so it is a window and no fold.
    """
    scans = Scans(key, *order)
    first = F.row_number().over(scans.window) == 1
    rises = lambda c: F.col(c) & ~F.col(reset) & ~first & ~F.coalesce(scans.previous(F.col(c)), F.lit(False))
    rows = rows.withColumn("__step", (rises(up).cast("long") - rises(down).cast("long"))).withColumn("__island", scans.island(F.col(reset)))
    inside = Window.partitionBy(scans.key, "__island").orderBy(*scans.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__sum", F.sum("__step").over(inside))
    half, whole = F.lit(1 << 31), F.lit(1 << 32)
    cv = F.pmod(F.col("__sum") + half, whole) - half
    flag = lambda beyond: F.max(beyond).over(inside)
    rows = rows.withColumn("cv", cv.cast("int")).withColumn("overflow", flag(F.col("__sum") >= half)).withColumn("underflow", flag(F.col("__sum") < -half))
    return rows.withColumn("done", F.col("cv") >= preset).drop("__step", "__island", "__sum")


def unread_one_shot(rows: DataFrame, scans: Scans, command: str, readable: str, name: str = "write") -> DataFrame:
    """``rows`` plus ``name``: one write a rising command, made on the first scan that can be read.

    A scan whose read fails doesn't use the edge up: the command is compared with that of
    the last scan that was read. A write that fails later is not made again.
    """
    seen = F.last(F.when(F.col(readable), F.col(command)), ignorenulls=True).over(scans.window.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.col(readable) & F.col(command) & ~F.coalesce(seen, F.lit(False)))


def drive_source(rows: DataFrame, scans: Scans, local: str, program: str, operator_run: str, program_run: str, name: str = "run") -> DataFrame:
    """``rows`` plus source (LOCAL, PROGRAM or OPERATOR) and ``name``.

    In local the drive runs by its own panel and gets no command; in program the command
    is as long as its level is true; else it is the operator's sealed-in one.
    """
    source = F.when(F.col(local), "LOCAL").when(F.col(program), "PROGRAM").otherwise("OPERATOR")
    rows = rows.withColumn("source", source)
    return rows.withColumn(name, F.when(F.col("source") == "LOCAL", False).when(F.col("source") == "PROGRAM", F.col(program_run)).otherwise(F.col(operator_run)))
