"""CRC-32 in DuckDB SQL, which has no such function."""

from __future__ import annotations

#: The 16-entry nibble table of the polynomial 0xEDB88320.
_NIBBLES = [0]
for _i in range(1, 16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES.append(_c)


def _step(c: str) -> str:
    return f"xor(({c}) >> 4, list_extract({_NIBBLES}, (({c}) & 15) + 1))"


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a non-null text's UTF-8 bytes."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {_step(_step('xor(c, b)'))}))::BIGINT"
