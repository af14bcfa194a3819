"""Pieces of DuckDB SQL that several operators' checks share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text expression's UTF-8 bytes, bit by bit (DuckDB has no function for it)."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda d, k: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295), 4294967295)"
