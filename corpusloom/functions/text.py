"""Column expressions over texts. All are built-in functions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression's class.
WS = r"[ \t\n\r\f\x0B]"
#: ASCII punctuation, escaped for a regular expression's class.
PUNCT = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def once(df: DataFrame, name: str, value: Column) -> tuple[DataFrame, Column]:
    """The frame with a column of that value, and the column: what several expressions use is computed once, since Spark doesn't
    merge a projection into another that uses a costly column twice. Drop it in the end."""
    name = f"__{name}"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, value), F.col(name)


def words(c: str | Column) -> Column:
    """Words between white space; none for the empty text."""
    return F.filter(F.split(col(c), WS + "+"), lambda w: w != "")


def n_words(c: str | Column) -> Column:
    """size(words(c)) without building the array."""
    return F.regexp_count(col(c), F.lit(r"[^ \t\n\r\f\x0B]+"))


def lines(c: str | Column, separator: str = "\n") -> Column:
    return F.split(col(c), separator)


def split_lines(c: str | Column, ends: str = LINE_ENDS) -> Column:
    """Lines as a text editor sees them: any line end (or those of the pattern), none after the last one."""
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(col(c), rf"(?:{ends})\z", ""), ends))


def total_length(strings: Column) -> Column:
    return F.aggregate(F.transform(strings, F.length), F.lit(0).cast("long"), lambda a, x: a + x)


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0; null stays null."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(a.cast("double") / b.cast("double"))


def lower(c: str | Column) -> Column:
    """Lower case letter by letter: a dotted capital I is an i, without a dot of its own behind it."""
    return F.lower(F.translate(col(c), "\u0130", "i"))


def normal_key(c: str | Column) -> Column:
    """Lower case without spaces, line ends and ASCII punctuation: the key of exact duplicates before hashing."""
    return F.regexp_replace(F.lower(col(c)), rf"[ \n{PUNCT}]", "")


def shingles(c: str | Column, n: int = 5) -> Column:
    """Windows of n words joined by spaces; one of all words if they are fewer; the empty one for no words."""
    w = words(c)
    return F.transform(w, lambda x: x) if n == 1 else _shingled(w, n)


def _shingled(w: Column, n: int) -> Column:
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  the words stand in the plan once
    return let(w, lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " ")))


def count_of(c: str | Column, needle: str) -> Column:
    """Occurrences without overlap."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def without(c: str | Column, pattern: str) -> Column:
    return F.regexp_replace(col(c), pattern, "")


def str_to_int(c: str | Column, seed: int = 42) -> Column:
    """32-bit murmur hash (the third version, for 32-bit machines) of the UTF-8 bytes, as an unsigned number."""
    low = F.lit(0xFFFFFFFF)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    times = lambda x, m: (x * (m & 0xFFFF) + F.shiftleft((x * (m >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(low)
    turned = lambda x, r: F.shiftleft(x, r).bitwiseOR(F.shiftright(x, 32 - r)).bitwiseAND(low)
    mixed = lambda k: times(let(times(k, 0xCC9E2D51), lambda x: turned(x, 15)), 0x1B873593)
    shifted = lambda h, r: let(h, lambda x: x.bitwiseXOR(F.shiftright(x, r)))
    raw = F.hex(F.encode(col(c), "utf-8"))

    def number(hexa: Column) -> Column:
        """Little-endian."""
        two = lambda i: F.substring(hexa, i, 2)
        return F.coalesce(F.conv(F.concat(two(7), two(5), two(3), two(1)), 16, 10).cast("long"), F.lit(0).cast("long"))

    def hashed(h: Column) -> Column:
        n = F.floor(F.length(h) / 2)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 4)), lambda i: F.substring(h, (i * 8 + 1).cast("int"), F.lit(8)))
        step = lambda s, k: F.when(F.length(k) == 8, (times(let(s.bitwiseXOR(mixed(number(k))), lambda x: turned(x, 13)), 5) + 0xE6546B64).bitwiseAND(low)).otherwise(s.bitwiseXOR(mixed(number(k))))
        state = F.aggregate(blocks, F.lit(seed).cast("long"), step).bitwiseXOR(n)
        return shifted(times(shifted(times(shifted(state, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)

    return let(raw, hashed)
