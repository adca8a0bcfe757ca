"""Text oracles: the tokeniser and the hashed text vectors as DuckDB SQL."""

from __future__ import annotations

from ..functions.text import TOKEN_PATTERN

# Every character with the Unicode White_Space property, as an RE2 class.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalized(column: str) -> str:
    return f"regexp_replace(lower({column}), '[{_SPACE}]+', ' ', 'g')"


def tokens(column: str) -> str:
    pattern = "(?i)" + TOKEN_PATTERN.replace(r"\s", _SPACE)
    return f"regexp_extract_all({normalized(column)}, {_quoted(pattern)})"


def hashed_vectors(source: str, keys: list[str], column: str, dim: int, name: str) -> str:
    """CTEs ending in `{name}_vectors`: the keys and `v`, the unit vector of float32 values."""
    key = ", ".join(keys)
    return f"""
{name}_tokens as (select {key}, unnest({tokens(column)}) as token from {source}),
{name}_cells as (select {key}, cast('0x' || substr(md5(token), 1, 8) as bigint) % {dim} as cell,
    cast(count(*) as double) as n from {name}_tokens group by all),
{name}_scaled as (select {key}, cell, cast(n / sqrt(sum(n * n) over (partition by {key})) as float) as value
  from {name}_cells),
{name}_maps as (select {key}, map(list(cell), list(cast(value as double))) as m from {name}_scaled group by {key}),
{name}_vectors as (select {', '.join('s.' + k for k in keys)},
    list_transform(range({dim}), lambda i: coalesce(m[i], cast(0 as double))) as v
  from {source} s left join {name}_maps using ({key}))"""


def vector_summary(source: str, keys: list[str], column: str, dim: int) -> str:
    """Per row: filled cells, largest value and a position-weighted sum of the vector."""
    key = ", ".join("s." + k for k in keys)
    return f"""with {hashed_vectors(source, keys, column, dim, 't')}
select {key}, cast(len(list_filter(v, lambda x: x > 0)) as bigint) as filled, list_max(v) as top,
  round(list_dot_product(v, list_transform(range({dim}), lambda i: cast(i + 1 as double))), 6) as weighted
from t_vectors s"""
