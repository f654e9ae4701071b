"""Pieces of DuckDB SQL that several oracles share."""

WS = r"[ \t\n\r\f\x0B]+"
PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def words(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}'), lambda w: w <> '')"


def ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END, 6)"


def total(strings: str) -> str:
    return f"coalesce(list_sum(list_transform({strings}, lambda s: length(s))), 0)::BIGINT"


def count_of(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, '{needle}', ''))) // {len(needle)})::BIGINT"


def where(items: str, test: str) -> str:
    return f"len(list_filter({items}, lambda x: {test}))"


KEY = r"""sha256(regexp_replace(lower(text), '[ \n!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'))"""
#: Characters of words as `\\w` means them, in RE2's classes.
WORD_CHARS = r"\p{L}\p{M}\p{Nd}\p{Pc}"
#: Runs without .!? that hold part of a word.
SENTENCES = rf"len(regexp_extract_all(text, '[^.!?]*[{WORD_CHARS}][^.!?]*'))::BIGINT"
