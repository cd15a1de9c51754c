"""Sequential decisions inside independent runs, streamed through sorted partitions.

For rules whose decision depends on earlier decisions (greedy selection, minimum spacing,
phrase grouping). Callers first split each key into runs that cannot influence each other,
so a hot key becomes many runs. Rows of a run arrive sorted in Arrow batches and only the
small state is held; no group is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_runs(df: DataFrame, run: list[str], order: list[str], inputs: list[str],
              start: Callable[[], object], step: Callable, name: str,
              dtype: T.DataType) -> DataFrame:
    """Add column `name` = step(state, *inputs), called row by row in order inside a run.

    `start` builds the state of a new run and `step` changes it in place.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, dtype)])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            marks = []
            ids = zip(*[batch[c].tolist() for c in run])
            rows = zip(*[batch[c].tolist() for c in inputs])
            for key, row in zip(ids, rows):
                if key != current:
                    current, state = key, start()
                marks.append(step(state, *row))
            yield batch.assign(**{name: pd.Series(marks, index=batch.index, dtype=object)
                                  if not marks else marks})

    return (df.repartition(*run).sortWithinPartitions(*run, *order)
            .mapInPandas(go, schema))


def unfold_runs(df: DataFrame, run: list[str], order: list[str], inputs: list[str], outputs: str,
                start: Callable[[], object], step: Callable, finish: Callable) -> DataFrame:
    """Rows (run columns, then `outputs`) made by a rule that gives any number of rows for each row.

    step(state, *inputs) and finish(state) return lists of tuples; `finish` is called after a run's last row. As in
    `fold_runs`, a run streams through sorted batches and only its state is held.
    """
    heads = [df.schema[c] for c in run]
    schema = T.StructType([*heads, *T._parse_datatype_string(outputs).fields])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        current, state, made = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*made)) if made else [()] * len(schema)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for rows in batches:
            cols = {n: rows.column(i).to_pylist() for i, n in enumerate(rows.schema.names)}
            for key, row in zip(zip(*[cols[c] for c in run]), zip(*[cols[c] for c in inputs])):
                if key != current:
                    if current is not None:
                        made += [(*current, *x) for x in finish(state)]
                    current, state = key, start()
                made += [(*key, *x) for x in step(state, *row)]
            if made:
                yield batch()
        if current is not None:
            made += [(*current, *x) for x in finish(state)]
        yield batch()

    need = list(dict.fromkeys([*run, *order, *inputs]))
    return (df.select(*need).repartition(*run).sortWithinPartitions(*run, *order)
            .select(*dict.fromkeys([*run, *inputs])).mapInArrow(go, schema))
