"""SQL text that Spark and DuckDB read alike, and the few places where they differ.

Marks in such text: R'...' is a raw pattern; RX(x, R'p', 's') replaces all matches; MATCH(x, R'p') searches; ENDS(x, 's') tests an end; DAYS(a, b) is
whole days from a to b; EPOCH(t) is whole seconds; AGG(x, sep, order) joins strings of a group; WORDS(x) is a list of words, JOINED and SORTED work on lists, FLAT makes rows
of one; STR is the string type.
"""

from __future__ import annotations

import re

SPARK, DUCK = "spark", "duckdb"


def _calls(text: str, name: str, build) -> str:
    """Rewrites each name(a, b, ...) by build(args), innermost last."""
    while (m := re.search(rf"\b{name}\(", text)) is not None:
        depth, args, at, quoted = 1, [], m.end(), False
        begin = at
        while depth:
            c = text[at]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c in "([") - (c in ")]")
                if c == "," and depth == 1:
                    args.append(text[begin:at].strip())
                    begin = at + 1
            at += 1
        args.append(text[begin : at - 1].strip())
        text = text[: m.start()] + build(*args) + text[at:]
    return text


def render(text: str, dialect: str) -> str:
    spark = dialect == SPARK
    text = _calls(text, "RX", lambda x, p, s: f"regexp_replace({x}, {p}, {s})" if spark else f"regexp_replace({x}, {p}, {s}, 'g')")
    text = _calls(text, "MATCH", lambda x, p: f"regexp_like({x}, {p})" if spark else f"regexp_matches({x}, {p})")
    text = _calls(text, "ENDS", lambda x, e: f"endswith({x}, {e})" if spark else f"ends_with({x}, {e})")
    text = _calls(text, "DAYS", lambda a, b: f"timestampdiff(DAY, {a}, {b})" if spark else f"datesub('day', {a}, {b})")
    text = _calls(text, "EPOCH", lambda t: f"unix_timestamp({t})" if spark else f"cast(floor(epoch({t})) as bigint)")
    text = _calls(text, "AGG", lambda x, sep, order: f"listagg({x}, {sep}) within group (order by {order})" if spark else f"string_agg({x}, {sep} order by {order})")
    text = _calls(text, "WORDS", lambda x: f"filter(split(trim({x}), r'(?U)\\s+'), x -> x <> '')" if spark else f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda x: x <> '')")
    text = _calls(text, "JOINED", lambda x, sep: f"array_join({x}, {sep})" if spark else f"array_to_string({x}, {sep})")
    text = _calls(text, "SORTED", lambda x: f"array_sort({x})" if spark else f"list_sort({x})")
    text = _calls(text, "FLAT", lambda x: f"explode({x})" if spark else f"unnest({x})")
    text = re.sub(r"\bSTR\b", "string" if spark else "varchar", text)
    return re.sub(r"\bR'", "r'" if spark else "'", text)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
