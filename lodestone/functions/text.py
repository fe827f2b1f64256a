"""Tokens, stems and sentences as SQL expressions for either dialect, and as Spark columns.

A stemmer's step is one CASE over the column w; the steps are layers of projections. Whether a stem's measure is above 0 or
1 is one pattern each, so nothing is counted. A mark (control character 1) carries "a suffix went" from a layer to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import STOPWORDS, SUFFIXES_2, SUFFIXES_3, SUFFIXES_4
from .sql import DUCK, SPARK, quoted, render

ABOVE_0 = "R'[^aeiou][aeiou]'"
ABOVE_1 = "R'[^aeiou][aeiou]+[^aeiou]+[aeiou]'"
CVC = "R'[^aeiou][aeiou][^aeiouwxy]$'"
VOWEL = "R'[aeiou]'"


def _ends(suffix: str, w: str = "w") -> str:
    return f"ENDS({w}, '{suffix}')"


def _cut(n: int, w: str = "w") -> str:
    return f"left({w}, length({w}) - {n})"


def _doubled(w: str) -> str:
    return f"(length({w}) >= 2 and right({w}, 1) = substr({w}, length({w}) - 1, 1) and not MATCH(right({w}, 1), {VOWEL}))"


def _table(rows: list[tuple[str, str]], measure: str) -> str:
    cases = []
    for suffix, new in rows:
        cases.append(f"when {_ends(suffix)} and MATCH({_cut(len(suffix))}, {measure}) then " + (f"{_cut(len(suffix))} || '{new}'" if new else _cut(len(suffix))))
    return "case " + " ".join(cases) + " else w end"


def stem_layers(dialect: str) -> list[str]:
    """Expressions over w, one after the other; for words longer than two characters."""
    mark, bare = "chr(1)", _cut(1)
    layers = [
        f"case when {_ends('sses')} or {_ends('ies')} then {_cut(2)} when {_ends('ss')} then w when {_ends('s')} then {_cut(1)} else w end",
        f"case when {_ends('eed')} then case when MATCH({_cut(3)}, {ABOVE_0}) then {_cut(1)} else w end"
        f" when {_ends('ed')} then case when MATCH({_cut(2)}, {VOWEL}) then {_cut(2)} || {mark} else w end"
        f" when {_ends('ing')} and MATCH({_cut(3)}, {VOWEL}) then {_cut(3)} || {mark} else w end",
        f"case when not ENDS(w, {mark}) then w"
        f" when right({bare}, 2) in ('at', 'bl', 'iz') then {bare} || 'e'"
        f" when {_doubled(bare)} and right({bare}, 1) not in ('l', 's', 'z') then {_cut(2)}"
        f" when MATCH({bare}, {ABOVE_0}) and not MATCH({bare}, {ABOVE_1}) and MATCH({bare}, {CVC}) then {bare} || 'e' else {bare} end",
        f"case when {_ends('y')} and MATCH({_cut(1)}, {VOWEL}) then {_cut(1)} || 'i' else w end",
        _table(SUFFIXES_2, ABOVE_0),
        _table(SUFFIXES_3, ABOVE_0),
        _table(SUFFIXES_4, ABOVE_1),
        f"case when {_ends('e')} and (MATCH({_cut(1)}, {ABOVE_1}) or (MATCH({_cut(1)}, {ABOVE_0}) and not MATCH({_cut(1)}, {CVC}))) then {_cut(1)} else w end",
        f"case when {_ends('ll')} and MATCH(w, {ABOVE_1}) then {_cut(1)} else w end",
    ]
    return [render(f"case when length(w0) <= 2 then w else {x} end", dialect) for x in layers]


def stemmed(df: DataFrame, word: str, term: str) -> DataFrame:
    """df with a column `term`: the stem of `word`.

    It comes out of a generator: a filter on it, such as a join infers, would else be rewritten down through the layers,
    each of which names its input many times.
    """
    out = df.withColumns({"w0": F.col(word), "w": F.col(word)})
    for layer in stem_layers(SPARK):
        out = out.withColumn("w", F.expr(layer))
    return out.withColumn(term, F.explode(F.array("w"))).drop("w", "w0")


def duck_stems(source: str) -> str:
    """DuckDB SQL: (w0, w) with the stem of every w0 in `source`."""
    sql = f"select w0, w0 as w from ({source})"
    for layer in stem_layers(DUCK):
        sql = f"select w0, {layer} as w from ({sql})"
    return sql


_KEEP = f"x not in ({quoted(STOPWORDS)}) and length(x) between 2 and 30 and (not MATCH(x, R'^[0-9]+$') or MATCH(x, R'^(19|20)[0-9][0-9]$'))"


def words(text: Column | str) -> Column:
    """All words of a text in lower case, seasons reduced to their year. What isn't a-z or 0-9 separates words."""
    col = F.col(text) if isinstance(text, str) else text
    low = F.lower(col)
    season = F.when(low.rlike("[0-9][/-][0-9]"), F.regexp_replace(low, r"\b(\d{4})[/\-]\d{2}\b", "$1")).otherwise(low)
    return F.split(season, "[^a-z0-9]+")  # may begin and end with an empty word


def indexed(word: Column) -> Column:
    """Whether a word is indexed."""
    return ~word.isin(STOPWORDS) & F.length(word).between(2, 30) & (~word.rlike("^[0-9]+$") | word.rlike("^(19|20)[0-9][0-9]$"))


def tokens(text: Column | str) -> Column:
    """Words of a text that are indexed, before stemming, in order."""
    return F.filter(words(text), indexed)


def duck_tokens(text: str) -> str:
    """The same as a DuckDB list; its \\b knows ASCII only, so the season rule names its neighbours, twice for shared ones."""
    season = f"lower({text})"
    for _ in range(2):
        season = f"regexp_replace({season}, '(^|[^\\p{{L}}\\p{{N}}_])(\\d{{4}})[/\\-]\\d{{2}}($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2\\3', 'g')"
    words = f"string_split_regex(trim(regexp_replace({season}, '[^a-z0-9\\s]', ' ', 'g')), '\\s+')"
    return f"list_filter({words}, lambda x: {render(_KEEP, DUCK)})"


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])(?U)\s+")
