"""Stream lines through the transformer, keyed by stream: one state (the held calls) each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from turnlake.functions.lines import Lines

OUT = "stream_id string, pos long, sub int, line string"
KIND = pa.schema([("stream_id", pa.string()), ("pos", pa.int64()), ("sub", pa.int32()), ("line", pa.string())])


def _fold(own: Lines, rows: pd.DataFrame) -> pd.DataFrame:
    """Lines in order of pos; a null line ends its stream, and what is still held goes out."""
    out = []
    for r in rows.sort_values(["pos", "line"], kind="stable").itertuples():
        got = own.close() if r.line is None else own.feed(r.line)
        out += [(r.stream_id, r.pos, k, x) for k, x in enumerate(got)]
    return pd.DataFrame(out, columns=["stream_id", "pos", "sub", "line"])


def transform_lines(lines: DataFrame, make: Callable[[], Lines]) -> DataFrame:
    """Batch: (stream_id, pos, line) to the lines sent on, each with the pos at which it went out and its place there.

    A task reads its streams one after the other, sorted, and holds one transformer at a time, so neither many short
    streams nor a very long one cost memory. Lines of the same pos go by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = make(), object()
        for batch in batches:
            out: list[tuple] = []
            for stream, pos, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stream != at:
                    own, at = make(), stream
                out += [(stream, pos, k, x) for k, x in enumerate(own.close() if line is None else own.feed(line))]
            yield pa.RecordBatch.from_pylist([dict(zip(KIND.names, r, strict=True)) for r in out], KIND)

    rows = lines.select(F.col("stream_id"), F.col("pos").cast("long").alias("pos"), "line")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "pos", F.asc_nulls_last("line")).mapInArrow(run, OUT)


def transform_lines_stream(lines: DataFrame, make: Callable[[], Lines]) -> DataFrame:
    """Streaming twin of `transform_lines`; needs the RocksDB state store. A stream's state goes when it ends."""

    class Transformer(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("held", StructType([StructField("json", StringType())]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            own = make().restored(self.state.get()[0]) if self.state.exists() else make()
            all_rows = pd.concat(list(rows))
            yield _fold(own, all_rows)
            if all_rows["line"].isna().any():
                self.state.clear()
            else:
                self.state.update((own.saved(),))

        def close(self) -> None:
            pass

    return lines.select("stream_id", "pos", "line").groupBy("stream_id").transformWithStateInPandas(statefulProcessor=Transformer(), outputStructType=OUT, outputMode="Append", timeMode="None")
