"""Scoring rows with a model that the caller brings: loaded once per partition, called on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# From a batch of the input columns to one array (or list) for each declared column.
Model = Callable[[pa.RecordBatch], "pa.RecordBatch | Mapping[str, object]"]
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def _slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and about ``size`` bytes; a larger row is a part of its own."""
    waiting = [batch]
    while waiting:
        part = waiting.pop()
        if part.num_rows > rows or (part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > size):
            half = min(rows, (part.num_rows + 1) // 2)
            waiting += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


def _declared(found: pa.RecordBatch | Mapping[str, object], schema: pa.Schema, rows: int) -> list[pa.Array]:
    """The model's columns in declared order and type; one that is missing, too long or of another type is an error."""
    names = found.schema.names if isinstance(found, pa.RecordBatch) else list(found)
    if missing := [f.name for f in schema if f.name not in names]:
        raise ValueError(f"the model returned no column {missing}, only {names}")
    columns = []
    for declared in schema:
        values = found.column(declared.name) if isinstance(found, pa.RecordBatch) else found[declared.name]
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        if len(values) != rows:
            raise ValueError(f"the model returned {len(values)} values of {declared.name!r} for {rows} rows")
        try:
            array = values.cast(declared.type) if isinstance(values, pa.Array) else pa.array(values, declared.type)
        except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError) as error:
            raise ValueError(f"the model's column {declared.name!r} is no {declared.type}: {error}") from error
        columns.append(array)
    return columns


def score_with(
    rows: DataFrame,
    load: Callable[[], Model],
    inputs: Sequence[str],
    schema: str,
    keep: Sequence[str],
    batch_rows: int = BATCH_ROWS,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """The columns ``keep`` of ``rows`` with those of ``schema`` (a DDL string), which the caller's model computes.

    ``load`` runs on the executors, once for each partition that has rows, and returns the model: a function from an
    Arrow batch of the columns ``inputs`` to a batch or mapping with the declared columns, a value for each row in order.
    It may read whatever every executor reaches; where the model has a ``close`` method, it is called when the partition
    ends, also by an error. A model sees at most ``batch_rows`` rows and about ``batch_bytes`` bytes at a time and must not
    depend on where batches end, as a lost task is repeated with others.

    Nulls reach the model as nulls, and a null it returns stays. An empty table loads nothing and gives no rows. A declared
    column with the name of a kept one, and a model whose columns don't fit the declaration, are errors. Rows are neither
    shuffled nor reordered.
    """
    declared = StructType.fromDDL(schema)
    clash = {f.name.lower() for f in declared} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are both kept and declared")
    # Input columns come first, under their own names, then those that are only carried along.
    selected = rows.select(*[rows[c].alias(f"in_{i}") for i, c in enumerate(inputs)], *[rows[c] for c in keep])
    out = StructType([*[rows.schema[c] for c in keep], *declared.fields])
    out_schema, model_schema = to_arrow_schema(out), to_arrow_schema(declared)
    count, names = len(inputs), list(inputs)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        try:
            for whole in batches:
                for batch in _slices(whole, batch_rows, batch_bytes):
                    if model is None:
                        model = load()
                    given = pa.RecordBatch.from_arrays(batch.columns[:count], names=names)
                    kept = [c.cast(out_schema.field(i).type) for i, c in enumerate(batch.columns[count:])]
                    found = _declared(model(given), model_schema, batch.num_rows)
                    yield pa.RecordBatch.from_arrays([*kept, *found], schema=out_schema)
        finally:
            close = getattr(model, "close", None)
            if close is not None:
                close()

    return selected.mapInArrow(scored, out)
