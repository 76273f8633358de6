"""Small builders for the DuckDB oracle texts (the same rules written in DuckDB SQL).

These only assemble SQL strings for the oracle side of ``oracle_sql()``; no query is parsed.
"""

from __future__ import annotations

NL_SEP = "' ' || chr(10) || ' '"  # ' \n '


def _ws_sql() -> str:
    from lexivec.functions.text import WHITESPACE

    return " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


WS = _ws_sql()


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def fp(*parts: str) -> str:
    body = " || ".join(f"coalesce({p} || chr(0), '')" for p in parts)
    return f"substr(sha256({body}), 1, 32)"


def ts_text(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN strftime({x}, '%f') = '000000' THEN strftime({x}, '%Y-%m-%d %H:%M:%S') "
        f"ELSE strftime({x}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


def ts_iso(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN strftime({x}, '%f') = '000000' THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def row_parts(cols: list[str], labelled: bool = False) -> str:
    """List of {n, p} for non-blank stripped values, in column order."""
    items = []
    for c in cols:
        v = strip(f"{c}::VARCHAR")
        p = f"'{c}: ' || {v}" if labelled else v
        items.append(f"CASE WHEN {v} <> '' THEN {{'n': '{c}', 'p': {p}}} END")
    return f"list_filter([{', '.join(items)}], lambda s: s IS NOT NULL)"


def row_docs_cte(table: str, pk: str, cols: list[str], labelled: bool = False, extras: list[str] | None = None) -> str:
    """SELECT of (table, pk, text, columns, row_fp) for the combined text of ``cols``."""
    parts = row_parts(cols, labelled)
    ex = ", ".join(f"{e} AS _x{i}" for i, e in enumerate(extras or []))
    fp_parts = ["text"] + [f"_x{i}" for i in range(len(extras or []))]
    return f"""
SELECT '{table}' AS "table", pk, text, columns, {fp(*fp_parts)} AS row_fp FROM (
  SELECT {pk}::VARCHAR AS pk,
         array_to_string(list_transform(parts, lambda s: s.p), {NL_SEP}) AS text,
         array_to_string(list_transform(parts, lambda s: s.n), ',') AS columns{', ' + ex if ex else ''}
  FROM (SELECT *, {parts} AS parts FROM {table})
  WHERE len(parts) > 0
)"""


def chunks_of(src: str, text: str = "text", size: int = 1200, min_chars: int = 8) -> str:
    """Rows of ``src`` times their kept chunks: adds chunk_idx, chunk."""
    return f"""
SELECT s.*, (o // {size})::INTEGER AS chunk_idx, substring(s.{text}, o + 1, {size}) AS chunk
FROM {src} s, unnest(range(0, length(s.{text}), {size})) AS u(o)
WHERE length(substring(s.{text}, o + 1, {size})) >= {min_chars}"""
