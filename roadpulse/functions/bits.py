"""Cut integers out of hex payloads with built-in expressions."""

from __future__ import annotations

# Bytes of the longest payload.
LONGEST = 64


def cut_plan(start: str = "start_bit", end: str = "start_bit", turned: str = "false") -> str:
    """SQL text of a struct telling which hex digits hold a signal and how to shift them into place.

    Needs columns size and is_signed; worked out once per signal definition, not per frame. Bits count from the top bit of
    byte 0, ``start`` is the first. A signal longer than 64 bits keeps its low 64 bits, and a 64-bit signal
    always reads as signed. A signal of more than 60 bits may reach into a 17th digit, of which ``spill`` says how many low
    bits to leave out. ``end`` plus the size are the bits that a payload must have.
    """
    width = "least(size, 64)"
    first = f"({start} + size - {width})"
    lead = f"pmod({first}, 4)"
    digits = f"cast(({lead} + {width} + 3) div 4 as int)"
    return f"""named_struct(
  'end_bit', {end} + size,
  'turned', {turned},
  'from_digit', cast({first} div 4 + 1 as int),
  'digits', least({digits}, 16),
  'up', 64 - least({digits}, 16) * 4 + {lead},
  'down', 64 - {width},
  'signed', is_signed or {width} = 64,
  'spill', if({digits} > 16, 4 - {lead}, null))"""


CUT_PLAN = cut_plan()

# The plan of a signal whose ``byte_order`` tells how start_bit is meant. "sequential": as in CUT_PLAN. "big": bit 8 * i + 7 is
# the top bit of byte i, and start_bit is the signal's top bit, from where it runs on downwards and into the next byte.
# "little": bit 8 * i is the low bit of byte i, and start_bit is the signal's low bit, from where it runs on upwards. In
# the payload with its bytes turned round and zeros in front up to LONGEST bytes, a little signal is a sequential one.
_BIG = "start_bit - pmod(start_bit, 8) + 7 - pmod(start_bit, 8)"
ORDERED_PLAN = cut_plan(
    f"(case byte_order when 'little' then {LONGEST * 8} - start_bit - size when 'big' then {_BIG} else start_bit end)",
    f"if(byte_order = 'big', {_BIG}, start_bit)", "byte_order = 'little'")


def turned(payload: str) -> str:
    """SQL text of the payload with its bytes in reverse order, zeros in front."""
    return f"lpad(regexp_replace(reverse({payload}), '(.)(.)', '$2$1'), {LONGEST * 2}, '0')"


def raw_value(payload: str, plan: str) -> str:
    """SQL text of the signal's integer: read up to 16 digits, move its top bit to bit 63, then back."""
    head = f"shiftleft(cast(conv(substring({payload}, {plan}.from_digit, {plan}.digits), 16, -10) as bigint), {plan}.up)"
    tail = f"shiftright(cast(conv(substring({payload}, {plan}.from_digit + 16, 1), 16, -10) as bigint), {plan}.spill)"
    moved = f"if({plan}.spill is null, {head}, {head} | {tail})"
    return f"if({plan}.signed, shiftright({moved}, {plan}.down), shiftrightunsigned({moved}, {plan}.down))"
