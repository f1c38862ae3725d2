"""Pieces of DuckDB SQL that the oracles of several operators share."""

from __future__ import annotations


def _register(steps: int) -> int:
    """CRC-32's register after ``steps`` shifts of a single low bit; negative steps undo them."""
    c = 1 << max(0, -steps)
    for _ in range(steps):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def crc32_ctes(source: str, text: str, name: str = "crc", doublings: int = 20) -> str:
    """CTEs that end in ``name``(s, crc32): unsigned CRC-32 of the UTF-8 bytes of the distinct texts of ``source``.

    DuckDB has no such function.  The register is linear, so the sum is the XOR
    of what each bit of the text becomes after the shifts that follow it:
    ``_at`` has that by number of shifts, made by doubling from ``_register``.
    Texts may have 2 ** (doublings - 3) bytes.
    """
    out = f"{name}_0 AS (SELECT m, 1::BIGINT << (-m) AS v FROM range(-31, 1) AS g(m)),\n"
    powers = {2**k for k in range(doublings)}
    wanted = {p - b for p in powers for b in range(32)}
    known, c = {m: _register(m) for m in wanted if m <= 0}, 1
    for m in range(1, max(powers) + 1):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        if m in wanted:
            known[m] = c
    for k in range(doublings):
        # rows reach from -31 to 2**k - 1; those from 0 on move by 2**k
        moved = "0"
        for b in range(32):
            moved = f"xor({moved}, ((v >> {b}) & 1) * {known[2**k - b]})"
        low = 0 if k else -31
        out += f"{name}_{k + 1} AS (SELECT m, v FROM {name}_{k} UNION ALL SELECT m + {2**k}, {moved} FROM {name}_{k} WHERE m >= {max(low, 1 - 2**k) if k else 0}),\n"
    return out + f"""{name}_at AS (SELECT a.m, a.v AS r0, b.v AS r1, c.v AS r2, d.v AS r3 FROM {name}_{doublings} a JOIN {name}_{doublings} b ON b.m = a.m - 1
  JOIN {name}_{doublings} c ON c.m = a.m - 2 JOIN {name}_{doublings} d ON d.m = a.m - 3 WHERE a.m % 4 = 0),
{name}_texts AS (SELECT DISTINCT {text} AS s FROM {source}),
{name}_ids AS (SELECT row_number() OVER () AS id, s, octet_length(encode(s)) AS n FROM {name}_texts),
{name}_nibbles AS (SELECT id, n, unnest(range(2 * n)) AS i, CAST('0x' || unnest(string_split(hex(encode(s)), '')) AS BIGINT) AS x FROM {name}_ids WHERE n > 0),
{name}_parts AS (
  SELECT id, bit_xor(xor(xor((x & 1) * r0, (x >> 1 & 1) * r1), xor((x >> 2 & 1) * r2, (x >> 3 & 1) * r3))) AS v
  FROM {name}_nibbles JOIN {name}_at ON m = 8 * (n - i // 2) - CASE WHEN i % 2 = 0 THEN 4 ELSE 0 END GROUP BY id
), {name}_start AS (
  SELECT id, bit_xor(v) AS v FROM {name}_ids, range(32) AS g(b) JOIN {name}_{doublings} ON m = 8 * n - b GROUP BY id
), {name} AS (
  SELECT s, xor(4294967295, xor({name}_start.v, coalesce({name}_parts.v, 0))) AS crc32 FROM {name}_ids JOIN {name}_start USING (id) LEFT JOIN {name}_parts USING (id)
)"""
