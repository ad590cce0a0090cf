from kvern.functions.hashing import HASHERS, partition_of
from kvern.functions.random import LinearCongruential, lcg_uniform, row_uniform
from kvern.functions.text import joined_text, tuple_text
from kvern.functions.units import in_unit, in_unit_column

__all__ = ["HASHERS", "LinearCongruential", "in_unit", "in_unit_column", "joined_text", "lcg_uniform", "partition_of", "row_uniform", "tuple_text"]
