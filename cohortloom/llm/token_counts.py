"""Token counts by a compiled finite-state tokenizer.

Texts are cut into chunks of ``CHUNK`` characters, each chunk is mapped by the
transducer of ``piece_transducer`` on its own, and the maps of a text are
composed in order by a prefix scan.  So one very long text is many small tasks'
worth of rows, and only its small chunk maps meet.

Defined cases: a NULL or empty text has 0 bytes and 0 tokens; repeated rows are
counted one by one; an empty table gives an empty result; other columns are
ignored unless kept, and a kept column with a result's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortloom.llm.piece_transducer import Map, transducer
from cohortloom.storage import materialize

CHUNK = 1 << 16
LIMIT = 4096
_SLICE_ROWS = 512
_MAP = T.StructType([T.StructField("head", T.StringType()), T.StructField("count", T.LongType()), T.StructField("tail", T.StringType())])


def _chunk_maps(rows: DataFrame, carried: Sequence[str], model: str) -> DataFrame:
    schema = T.StructType([rows.schema[c] for c in carried] + [T.StructField("n_tokens", T.LongType()), T.StructField("map", _MAP)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, machine = to_arrow_schema(schema), transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                totals, maps = [], []
                for chunk, alone in zip(part.column(len(carried)).to_pylist(), part.column(len(carried) + 1).to_pylist()):
                    one = machine.chunk_map(chunk)
                    totals.append(machine.total(one) if alone else None)
                    maps.append(None if alone else one._asdict())
                own = [part.column(i).cast(arrow.field(i).type) for i in range(len(carried))]
                found = [pa.array(v, arrow.field(len(carried) + i).type) for i, v in enumerate((totals, maps))]
                yield pa.RecordBatch.from_arrays([*own, *found], schema=arrow)

    return rows.select(*carried, "_chunk", (F.col("_n_chunks") <= 1).alias("_alone")).mapInArrow(run, schema)


def _compose(parts: DataFrame, carried: Sequence[str], model: str) -> DataFrame:
    schema = T.StructType([parts.schema[c] for c in carried] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, machine = to_arrow_schema(schema), transducer(model)
        for batch in batches:
            lists = batch.column(len(carried)).to_pylist()
            totals = [machine.total(machine.scan([Map(**p["map"]) for p in maps])) for maps in lists]
            own = [batch.column(i).cast(arrow.field(i).type) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(totals, pa.int64())], schema=arrow)

    return parts.select(*carried, "_maps").mapInArrow(run, schema)


def count(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), text: str = "text",
          limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """The ``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    body = F.coalesce(F.col(text), F.lit(""))
    # the model's dummy prefix: a space before every text that is not empty
    full = F.when(F.col("_body") == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("_body")))
    size = F.greatest(F.lit(1), F.ceil(F.char_length("_full") / F.lit(chunk))).cast("int")
    rows = (
        docs.select(*keep, body.alias("_body"))
        .withColumns({"n_bytes": F.octet_length("_body").cast("long"), "_row": F.monotonically_increasing_id(), "_full": full})
        .drop("_body").withColumn("_n_chunks", size)
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n_chunks") - 1)))
        .withColumn("_chunk", F.when(F.col("_n_chunks") == 1, F.col("_full")).otherwise(
            F.substring("_full", F.col("_at") * chunk + 1, F.lit(chunk))))
        .drop("_full")
    )
    carried = [*keep, "n_bytes", "_row", "_at"]
    mapped = materialize(_chunk_maps(rows, carried, model), "chunk-maps")
    alone = mapped.where(F.col("n_tokens").isNotNull()).select(*keep, "n_bytes", "n_tokens")
    parts = mapped.where(F.col("n_tokens").isNull()).groupBy(*keep, "n_bytes", "_row").agg(
        F.sort_array(F.collect_list(F.struct("_at", "map"))).alias("_maps"))
    joined = _compose(parts, [*keep, "n_bytes"], model)
    return alone.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
