"""Expressions over program text: comments, the lines of matches, tokens and constants.

Matches are found by small Arrow functions, one pass of Python's ``re`` a pattern over a batch of texts: built-in expressions would scan a
text again for each group and interpret a fold for each match. Patterns see ASCII letters, digits and white space alone, as built-in ones do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# String literals and comments, a string constant, a literal.
STRINGS_AND_COMMENTS = r""""[^"\\]*+(?:\\[^\n\r\x85  ][^"\\]*+)*+"|'[^'\\]*+(?:\\[^\n\r\x85  ][^'\\]*+)*+'|`[^`\\]*+(?:\\[^\n\r\x85  ][^`\\]*+)*+`|//[^\n\r]*|/\*[\s\S]*?\*/"""
CONSTANT = r"""\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*["'`]([^"'`]*)["'`]\s*;"""
LITERAL = r"""^["'`]([^"'`]*)["'`]$"""

#: A match: which pattern it is of, the line of its first code point (from 1), its whole text and up to three groups.
MATCHES = "array<struct<kind:string,line:int,whole:string,a:string,b:string,c:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def breaks(text: Column) -> Column:
    """The number of line breaks of a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _blanker() -> Callable[[str], str]:
    """What blanks the comments of one text; made anew for each use, so tasks get it whole."""
    pattern = re.compile(STRINGS_AND_COMMENTS, re.ASCII)

    def kept(m: re.Match) -> str:
        return m[0] if m[0][0] in "\"'`" else "\n".join([" " * len(line) for line in m[0].split("\n")])

    return lambda t: pattern.sub(kept, t)


def blank_comments(text: Column) -> Column:
    """A program with its comments blanked: string literals stay, and so does the place of everything else."""
    blanked = _blanker()

    @F.arrow_udf("string")
    def blank(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else blanked(t) for t in texts.to_pylist()], pa.string())

    return blank(text)


def matches(text: Column, kind: str, pattern: str, groups: Sequence[int] = (), needles: Sequence[str] = ()) -> Column:
    """All matches of a pattern (never empty ones), in order: see MATCHES."""
    return all_matches(text, [(kind, pattern, groups, needles)])


def all_matches(text: Column, patterns: Sequence[tuple], in_code: Sequence[tuple] = (), is_code: Column | None = None) -> Column:
    """The matches of several patterns (kind, pattern, groups, needles), those of one after those of another: see MATCHES; none in a null text.

    Each pattern passes over a text once and carries the line along; a text that holds none of its ``needles``, if it has any, has no match. A group
    that takes no part in a match is empty. The patterns ``in_code`` follow; they see texts of which ``is_code`` holds, with comments blanked.
    """
    plain, coded = ([(p[0], re.compile(p[1], re.ASCII), tuple(p[2]), tuple(p[3]) if len(p) > 3 else ()) for p in ps] for ps in (patterns, in_code))
    names, blanked = ("kind", "line", "whole", "a", "b", "c"), _blanker()

    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array, code: pa.Array) -> pa.Array:
        columns, offsets = {n: [] for n in names}, [0]
        kinds, lines, wholes = columns["kind"], columns["line"], columns["whole"]

        def look(t: str, every: list[tuple]) -> None:
            for kind, pattern, groups, needles in every:
                if needles and not any(n in t for n in needles):
                    continue
                line, at = 1, 0
                for m in pattern.finditer(t):
                    line, at = line + t.count("\n", at, m.start()), m.start()
                    kinds.append(kind)
                    lines.append(line)
                    wholes.append(m[0])
                    for i, n in enumerate("abc"):
                        columns[n].append((m[groups[i]] or "") if i < len(groups) else None)

        for t, c in zip(texts.to_pylist(), code.to_pylist()):
            if t is not None:
                look(t, plain)
                if c and coded:
                    look(blanked(t), coded)
            offsets.append(len(kinds))
        kept = pa.StructArray.from_arrays([pa.array(columns[n], pa.int32() if n == "line" else pa.string()) for n in names], names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept)

    return found(text, F.lit(False) if is_code is None else is_code)


def constants(text: Column) -> Column:
    """The string constants of a program by name; of several of one name the last counts."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(CONSTANT), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(CONSTANT), F.lit(2)).alias("v"))
    last = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda s, x: F.array_append(F.filter(s, lambda y: y["k"] != x["k"]), x))
    return F.map_from_entries(last)


def resolve_token(token: Column, known: Column) -> Column:
    """(value, resolved): a literal's content, a constant's value, else the token itself."""
    t = F.trim(token)
    literal, constant = F.regexp_extract(t, LITERAL, 1), known[t]
    value = F.when(t.rlike(LITERAL), literal).otherwise(F.coalesce(constant, F.when(t == "", "<unknown>").otherwise(t)))
    return F.struct(value.alias("value"), (t.rlike(LITERAL) | constant.isNotNull()).alias("resolved"))
