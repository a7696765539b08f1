"""Spark SQL expressions for arrays: running values and match offsets.

Expressions are built as SQL text. A column of nested lambdas costs hundreds of
calls into the JVM when built function by function, and one call as text.
"""

from __future__ import annotations

from collections.abc import Callable

_BLOCK = 256
MATCHES = "array<struct<start:int,end:int,text:string>>"


def raw(value: str) -> str:
    """A SQL literal taken as written, for regular expressions."""
    if "'" in value:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"r'{value}'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fence(value: str) -> str:
    """``value``, kept by the optimizer as a column of its own.

    A filter on a column is pushed down by putting the column's definition in its
    place, again at every step below. For columns made in many steps the filter
    grows beyond what can be planned, and the work is done twice. Filters that
    should reach the scan belong before such a column.
    """
    return f"case when spark_partition_id() >= 0 then {value} end"


def exclusive_scan(values: str, zero: str, merge: Callable[[str, str], str]) -> str:
    """``out[i]`` is the merge of ``zero`` and ``values[0..i-1]``, over ints.

    Works in two levels of blocks, since appending to one growing array would be
    quadratic for a text with many matches.
    """

    def within(block: str, seed: str) -> str:
        return (
            f"aggregate({block}, named_struct('acc', {seed}, 'out', cast(array() as array<int>)), "
            f"(s, v) -> named_struct('acc', {merge('s.acc', 'v')}, 'out', concat(s.out, array(s.acc)))).out"
        )

    blocks = (
        f"if(size(vals) = 0, cast(array() as array<array<int>>), transform(sequence(0, "
        f"cast(floor((size(vals) - 1) / {_BLOCK}) as int)), b -> slice(vals, b * {_BLOCK} + 1, {_BLOCK})))"
    )
    totals = f"transform(blocks, b -> aggregate(b, {zero}, (s, v) -> {merge('s', 'v')}))"
    return let("vals", values, let("blocks", blocks,
               f"flatten(zip_with(blocks, {within(totals, zero)}, (b, seed) -> {within('b', 'seed')}))"))


def find_all(text: str, pattern: str) -> str:
    """All matches of ``pattern``, left to right, as an array of strings."""
    return f"regexp_extract_all({text}, {raw(pattern)}, 0)"


def locate(text: str, pattern: str, matches: str) -> str:
    """``array<struct<start,end,text>>`` of ``matches = find_all(text, pattern)``.

    Offsets are code points. The text between matches comes from splitting at
    the same pattern; a match starts where the gaps and matches before it end.
    """
    pairs = (
        f"zip_with({matches}, slice(split({text}, {raw(pattern)}, -1), 1, size({matches})), "
        "(m, g) -> named_struct('gap', length(g), 'len', length(m), 'text', m))"
    )
    totals = exclusive_scan("transform(pairs, p -> p.gap + p.len)", "0", lambda a, v: f"{a} + {v}")
    return let("pairs", pairs,
               f"zip_with(pairs, {totals}, (p, t) -> named_struct('start', t + p.gap, "
               "'end', t + p.gap + p.len, 'text', p.text))")


def spans_of(text: str, pattern: str) -> str:
    """All matches of ``pattern`` with offsets, for one-off use."""
    return let("hits", find_all(text, pattern), locate(text, pattern, "hits"))
