"""Rows as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tuple_text(id_: str = "id", payload: str = "payload") -> Column:
    return F.concat_ws(", ", F.col(id_).cast("string"), F.col(payload).cast("string"))


def joined_text(id_: str = "id", payload_a: str = "payload_a", payload_b: str = "payload_b") -> Column:
    return F.concat_ws(", ", *(F.col(c).cast("string") for c in (id_, payload_a, payload_b)))
