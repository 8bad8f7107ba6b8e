"""Turn a signal value of mixed type (a variant) into one wanted type.

Each reading is SQL text over a variant column ``v`` and its kind ``k`` (see
KIND). It branches on the kind first: a plain cast would turn ``true`` into 1.0
and ``"yes"`` into true, and neither is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind of a value from its ``schema_of_variant`` text. Whole numbers beyond bigint come back as
# decimals of scale 0 and 19 or more digits.
KIND = r"""case
  when {s} = 'BIGINT' then 'integer'
  when {s} in ('DOUBLE', 'FLOAT') then 'decimal'
  when {s} = 'STRING' then 'string'
  when {s} = 'BOOLEAN' then 'boolean'
  when {s} = 'VOID' then 'null'
  when startswith({s}, 'DECIMAL') then
    if({s} rlike '^DECIMAL\\((19|[23][0-9]),0\\)$', 'integer', 'decimal')
  when startswith({s}, 'OBJECT') then 'object'
  when startswith({s}, 'ARRAY') then 'array' end"""

_TEXT = "try_variant_get({v}, '$', 'string')"
_REAL = "try_variant_get({v}, '$', 'double')"
# Whole numbers reach beyond bigint; of those over 38 digits, which JSON reading makes doubles, none are whole.
_LOW = "cast(pmod(try_variant_get({v}, '$', 'decimal(38,0)'), 4294967296) as bigint)"

# Numbers and numeric text. The special words count only as NaN and Infinity, spelt so.
AS_DOUBLE = f"""case
  when {{k}} in ('integer', 'decimal') then {_REAL}
  when {{k}} = 'string' and (not lower(btrim({_TEXT})) rlike '^[+-]?(nan|inf|infinity)$'
    or btrim({_TEXT}) rlike '^[+-]?(NaN|Infinity)$') then try_cast({_TEXT} as double) end"""

# 32-bit reading of a number: whole numbers keep their low 32 bits, decimals are cut and clamped.
_INT_OF_NUMBER = f"""if({{k}} = 'integer', shiftright(shiftleft({_LOW}, 32), 32),
  case when isnan({_REAL}) then 0L when {_REAL} >= 2147483647 then 2147483647L
    when {_REAL} <= -2147483648 then -2147483648L else try_cast({_REAL} as bigint) end)"""

# Numbers, and text of a sign and digits only.
AS_INTEGER = f"""case
  when {{k}} in ('integer', 'decimal') then {_INT_OF_NUMBER}
  when {{k}} = 'string' and {_TEXT} rlike '^[+-]?[0-9]+$' then cast(try_cast({_TEXT} as int) as bigint) end"""

# Text is true only for "true" in any case; numbers by their integer reading.
AS_BOOLEAN = f"""case
  when {{k}} = 'boolean' then try_variant_get({{v}}, '$', 'boolean')
  when {{k}} = 'string' then lower({_TEXT}) = 'true'
  when {{k}} in ('integer', 'decimal') then {_INT_OF_NUMBER} <> 0 end"""

# Printed form; decimals print as doubles (1.0 stays 1.0).
AS_STRING = f"""case
  when {{k}} = 'decimal' then cast({_REAL} as string)
  when {{k}} <> 'null' then {_TEXT} end"""

READINGS = {
    "as_double": AS_DOUBLE, "as_integer": AS_INTEGER, "as_boolean": AS_BOOLEAN, "as_string": AS_STRING,
}


def parse_int(text: Column, kind: str = "int") -> Column:
    """Strict text to integer: sign and digits only, no spaces; out of range is null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast(kind))
