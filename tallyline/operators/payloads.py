"""Payload columns to typed columns and back, over whole topics.

Every function takes and returns a DataFrame, batch or streaming. Decoders add
their columns and ``error``, which says why a payload could not be read; other
columns pass through untouched. Rows are read where they lie: nothing here
moves data between tasks.

Conditions on other columns (partition, offset, key) belong before a decoder:
Spark does not carry them back over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import payload_arrow, payload_sql
from tallyline.sources.schemas import INT_LIST, MESSAGE, SUM, record_fields, record_kind

_ENGINES = ("arrow", "sql")
_DECODED = "_decoded"


def _spread(df: DataFrame, decoded: Column, *fields: str) -> DataFrame:
    kept = [name for name in df.columns if name not in (*fields, "error")]
    return df.withColumn(_DECODED, decoded).select(
        *kept, *[F.col(f"{_DECODED}.{name}").alias(name) for name in (*fields, "error")]
    )


def _check(engine: str) -> None:
    if engine not in _ENGINES:
        raise ValueError(f"engine must be one of {_ENGINES}")


def decode_int_lists(df: DataFrame, value: str = "value", engine: str = "arrow") -> DataFrame:
    """Adds ``numbers`` (64-bit items of all blocks) and ``error``."""
    _check(engine)
    read = payload_arrow.int_list if engine == "arrow" else payload_sql.decode_int_list
    return _spread(df, read(F.col(value)), "numbers")


def list_sum(df: DataFrame, numbers: str = "numbers", out: str = "sum") -> DataFrame:
    """Adds the 64-bit sum of each list; 0 for an empty one. A list whose sum
    does not fit gets NULL and, where the frame has ``error``, a reason."""
    df = df.withColumn(out, payload_sql.list_sum(F.col(numbers)))
    if "error" not in df.columns:
        return df
    spilled = F.col(numbers).isNotNull() & F.col(out).isNull()
    reason = F.when(spilled, F.lit(payload_sql.SUM_OVERFLOW))
    return df.withColumn("error", F.coalesce(F.col("error"), reason))


def sum_int_lists(df: DataFrame, value: str = "value", engine: str = "arrow") -> DataFrame:
    """Decoding and summing in one step: adds ``sum`` and ``error``."""
    _check(engine)
    if engine == "arrow":
        return _spread(df, payload_arrow.int_list_sum(F.col(value)), "sum")
    return list_sum(decode_int_lists(df, value, "sql")).drop("numbers")


def resum_int_lists(df: DataFrame, value: str = "value", engine: str = "arrow") -> DataFrame:
    """Decoding, summing and encoding in one step: the sum payload takes the
    place of the list payload. A payload that cannot be read stays as it is."""
    _check(engine)
    if engine == "arrow":
        kept = df.withColumnRenamed(value, "_payload")
        summed = _spread(kept, payload_arrow.int_list_sum_bytes(F.col("_payload")), value)
    else:
        summed = sum_int_lists(df.withColumn("_payload", F.col(value)), value, engine)
        summed = summed.withColumn(value, payload_sql.encode_sum(F.col("sum"))).drop("sum")
    return summed.withColumn(value, F.coalesce(value, "_payload")).drop("_payload")


def decode_sums(df: DataFrame, value: str = "value", engine: str = "arrow") -> DataFrame:
    """Adds ``sum`` and ``error``."""
    _check(engine)
    sums = payload_arrow.leading_number if engine == "arrow" else payload_sql.decode_sum
    return _spread(df, sums(F.col(value)), "sum")


def decode_messages(df: DataFrame, value: str = "value", engine: str = "arrow") -> DataFrame:
    """Adds ``message_id``, ``event_time``, ``content`` and ``error``."""
    _check(engine)
    read = payload_arrow.message if engine == "arrow" else payload_sql.decode_message
    return _spread(df, read(F.col(value)), "message_id", "event_time", "content")


def encode_int_lists(
    df: DataFrame, numbers: str = "numbers", value: str = "value", engine: str = "arrow"
) -> DataFrame:
    _check(engine)
    encode = payload_arrow.int_list_bytes if engine == "arrow" else payload_sql.encode_int_list
    return df.withColumn(value, encode(F.col(numbers).cast("array<bigint>")))


def encode_sums(
    df: DataFrame, column: str = "sum", value: str = "value", engine: str = "arrow"
) -> DataFrame:
    _check(engine)
    encode = payload_arrow.number_bytes if engine == "arrow" else payload_sql.encode_sum
    return df.withColumn(value, encode(F.col(column).cast("bigint")))


def encode_messages(
    df: DataFrame,
    message_id: str = "message_id",
    event_time: str = "event_time",
    content: str = "content",
    value: str = "value",
) -> DataFrame:
    return df.withColumn(
        value,
        payload_arrow.message_bytes(
            F.col(message_id).cast("bigint"),
            F.col(event_time).cast("double"),
            F.col(content).cast("string"),
        ),
    )


def decode_topic(
    df: DataFrame, avsc: str | dict, value: str = "value", engine: str = "arrow"
) -> DataFrame:
    """Decodes a topic by a record schema: the shape of the record picks the
    decoder, its field names become the columns. Whole numbers stay 64 bits wide.
    Shapes without a decoder of their own are read field by field."""
    fields = record_fields(avsc)
    kind, names = record_kind(avsc), [name for name, _ in fields]
    if kind == INT_LIST:
        decoded, made = decode_int_lists(df, value, engine), ["numbers"]
    elif kind == SUM:
        decoded, made = decode_sums(df, value, engine), ["sum"]
    elif kind == MESSAGE:
        decoded = decode_messages(df, value, engine)
        made = ["message_id", "event_time", "content"]
    else:
        return decode_records(df, avsc, value, engine)
    return decoded.withColumnsRenamed(dict(zip(made, names, strict=True)))


def decode_records(
    df: DataFrame, avsc: str | dict, value: str = "value", engine: str = "arrow"
) -> DataFrame:
    """Adds a column per field of any flat record, and ``error``. Columns of the frame
    with the name of a field are replaced. An absent optional field is NULL."""
    if engine != "arrow":
        raise ValueError("records of any shape are decoded by the arrow engine")
    fields = record_fields(avsc)
    names = [name for name, _ in fields]
    read = payload_arrow.record([kind for _, kind in fields])
    kept = [F.col(name) for name in df.columns if name not in (*names, "error")]
    spread = [F.col(f"{_DECODED}.f{i}").alias(name) for i, name in enumerate(names)]
    decoded = df.withColumn(_DECODED, read(F.col(value)))
    return decoded.select(*kept, *spread, F.col(f"{_DECODED}.error").alias("error"))


def encode_records(df: DataFrame, avsc: str | dict, value: str = "value") -> DataFrame:
    """Adds the payload of a flat record made of the columns with its fields' names. A
    NULL in a field that is not optional makes a NULL payload."""
    fields = record_fields(avsc)
    write = payload_arrow.record_bytes([kind for _, kind in fields])
    types = [payload_arrow._spark_type(kind) for _, kind in fields]
    columns = [F.col(n).cast(t) for (n, _), t in zip(fields, types, strict=True)]
    return df.withColumn(value, write(*columns))


def drop_null_values(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col(value).isNotNull())


def split_quarantine(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows that could be decoded, and the others with origin and reason.

    Two frames mean two passes; a job that writes both uses the routed form of
    ``plans.jobs``, which needs one.
    """
    origin = [F.col(n) for n in ("topic", "partition", "offset")]
    good = df.where(F.col("error").isNull()).drop("error")
    bad = df.where(F.col("error").isNotNull())
    return good, bad.select(*origin, F.col(value).alias("value"), "error")


# Fixed values that stand in for missing fields.
MISSING_FIELDS = {"message_id": 0, "event_time": 0.0, "content": "Unknown"}


def with_defaults(
    df: DataFrame, policy: str = "zero", received: str = "received_time"
) -> DataFrame:
    """Fills missing message fields: ``zero`` with fixed values, ``received``
    only the event time, with the time of receipt. Set-aside rows stay empty."""
    if policy == "zero":
        fills = {name: F.lit(v) for name, v in MISSING_FIELDS.items() if name in df.columns}
    elif policy == "received":
        fills = {"event_time": F.col(received)}
    else:
        raise ValueError("policy must be 'zero' or 'received'")
    if "error" in df.columns:
        fills = {name: F.when(F.col("error").isNull(), fill) for name, fill in fills.items()}
    return df.withColumns({name: F.coalesce(F.col(name), fill) for name, fill in fills.items()})
