"""Source code: quality features, headers, rows of whole repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_ENDS, col, count_of, count_where, lower, once, ratio, split_lines

#: Keywords and the languages they are looked for in.
GENERATED = ("auto-generated", "autogenerated", "automatically generated")
CONFIG_OR_TEST = ("unit tests", "test file", "configuration file")
PYTHON_KEYWORDS = ("def ", "class ", "for ", "while ")
ASSIGNING = ("java", "python", "c", "c++", "c#", "go", "javascript", "ruby", "perl", "swift", "rust", "r", "matlab")


def line_stats(df: DataFrame, text: str = "text", longest: int = 7, ends: str = LINE_ENDS) -> DataFrame:
    df, sizes = once(df, "sizes", F.transform(split_lines(text, ends), F.length))
    top = F.slice(F.reverse(F.array_sort(sizes)), 1, longest)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumns({"line_mean": ratio(total(sizes), F.size(sizes)), "line_max": F.coalesce(F.array_max(sizes), F.lit(0)).cast("long"), "avg_longest_lines": ratio(total(top), F.size(top)), "num_lines": F.size(sizes).cast("long")}).drop(sizes)


#: Letters and numbers that came with Unicode 14 and 15, which Java's classes may lack; looked for only where they can be.
_LETTERS = (
    r"\x{870}-\x{887}\x{889}-\x{88E}\x{8B5}\x{8C8}-\x{8C9}\x{C5D}\x{CDD}\x{170D}\x{171F}\x{1B4C}"
    r"\x{2C2F}\x{2C5F}\x{9FFD}-\x{9FFF}\x{A7C0}-\x{A7C1}\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}\x{A7F2}-\x{A7F4}\x{10570}-\x{1057A}"
    r"\x{1057C}-\x{1058A}\x{1058C}-\x{10592}\x{10594}-\x{10595}\x{10597}-\x{105A1}\x{105A3}-\x{105B1}\x{105B3}-\x{105B9}\x{105BB}-\x{105BC}\x{10780}-\x{10785}\x{10787}-\x{107B0}"
    r"\x{107B2}-\x{107BA}\x{10F70}-\x{10F81}\x{11071}-\x{11072}\x{11075}\x{1123F}-\x{11240}\x{11740}-\x{11746}\x{11AB0}-\x{11ABF}\x{11F02}\x{11F04}-\x{11F10}"
    r"\x{11F12}-\x{11F33}\x{12F90}-\x{12FF0}\x{1342F}\x{13441}-\x{13446}\x{16A70}-\x{16ABE}\x{1AFF0}-\x{1AFF3}\x{1AFF5}-\x{1AFFB}\x{1AFFD}-\x{1AFFE}\x{1B11F}-\x{1B122}"
    r"\x{1B132}\x{1B155}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}\x{1E030}-\x{1E06D}\x{1E290}-\x{1E2AD}\x{1E4D0}-\x{1E4EB}\x{1E7E0}-\x{1E7E6}\x{1E7E8}-\x{1E7EB}"
    r"\x{1E7ED}-\x{1E7EE}\x{1E7F0}-\x{1E7FE}\x{2A6DE}-\x{2A6DF}\x{2B735}-\x{2B739}\x{31350}-\x{323AF}"
)
_NUMBERS = r"\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1D2C0}-\x{1D2D3}\x{1E4F0}-\x{1E4F9}"
LETTER = rf"[\p{{L}}[\x{{870}}-\x{{323AF}}&&[{_LETTERS}]]]"
ALPHANUMERIC = rf"[\p{{L}}\p{{N}}[\x{{870}}-\x{{323AF}}&&[{_LETTERS}{_NUMBERS}]]]"


def alphanumeric_share(text: str | Column) -> Column:
    return ratio(F.regexp_count(col(text), F.lit(ALPHANUMERIC)), F.length(col(text)))


def alphabetic_percent(text: str | Column) -> Column:
    return ratio(100 * F.regexp_count(col(text), F.lit(LETTER)), F.length(col(text)))


def _any_in(c: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | c.contains(n)
    return found


def is_generated(text: str | Column, head: int = 5, ends: str = LINE_ENDS) -> Column:
    return F.exists(F.slice(split_lines(text, ends), 1, head), lambda x: _any_in(lower(x), GENERATED))


def is_config_or_test(text: str | Column, head: int = 5, share: float = 0.2, ends: str = LINE_ENDS) -> Column:
    """Keywords in the first lines, or more `config` or `test` than `share` of the line ends. Counts only rise, so totals decide."""
    few = F.floor(count_of(text, "\n") * share)
    low = lower(text)
    return F.exists(F.slice(split_lines(text, ends), 1, head), lambda x: _any_in(lower(x), CONFIG_OR_TEST)) | (count_of(low, "config") > few) | (count_of(low, "test") > few)


def has_no_keywords(text: str | Column, language: str | Column) -> Column:
    return (F.lower(col(language)) == "python") & ~_any_in(F.lower(col(text)), PYTHON_KEYWORDS)


def has_few_assignments(text: str | Column, language: str | Column, least: int = 4) -> Column:
    return F.lower(col(language)).isin(list(ASSIGNING)) & (count_of(text, "=") <= least)


def is_xml(text: str | Column, language: str | Column) -> Column:
    return (F.lower(col(language)) != "xslt") & F.substring(col(text), 1, 100).contains("<?xml version=")


def is_html(text: str | Column, language: str | Column, share: float = 0.2, least: int = 100) -> Column:
    """HTML whose text, markup, scripts and styles apart, is a good part of it."""
    shown = F.regexp_replace(F.regexp_replace(col(text), r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->|<[^>]*>", "")
    return (F.lower(col(language)) == "html") & (ratio(F.length(shown), F.length(col(text))) > share) & (F.length(shown) > least)


def top_words(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, top_word_percent, top_two_words_percent (0 with one distinct word), for all rows."""
    ids = df.select(col(id_column).alias("id"), F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?U)\b\w+\b"), F.lit(0)).alias("ws"))
    counted = ids.select("id", F.explode("ws").alias("w")).groupBy("id", "w").agg(F.count("*").alias("k"))
    two = counted.groupBy("id").agg(F.sum("k").alias("n"), F.max("k").alias("a"))
    second = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("k"), "w"))).where("r <= 2").groupBy("id").agg(F.sum("k").alias("ab"), F.count("*").alias("have"))
    out = ids.select("id").join(two, "id", "left").join(second, "id", "left")
    return out.select("id", F.coalesce(100.0 * F.col("a") / F.col("n"), F.lit(0.0)).alias("top_word_percent"), F.coalesce(F.when(F.col("have") >= 2, 100.0 * F.col("ab") / F.col("n")), F.lit(0.0)).alias("top_two_words_percent"))


#: Long base64, hexadecimal and escaped-Unicode runs. Hexadecimal numbers end at ASCII words' ends, so that an accented
#: letter next to one is none of its word. No run is given back, so runs of any length need no stack.
_HEX = r"(?:(?:(?<![0-9A-Za-z_])(?:0x)?|(?<=[0-9A-Za-z_])\\x)[0-9a-fA-F]{2}(?:,|(?![0-9A-Za-z_])[\t\n\f\r ]*)){8,}+"
ENCODED = (r"[a-zA-Z0-9+/\n=]{64,}", _HEX, r"(?:\\u[0-9a-fA-F]{4}){8,}")


def encoded_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Length of the longest encoded run, and all runs' share of the text (runs of two kinds count twice)."""
    df, runs = once(df, "runs", F.concat(*[F.transform(F.regexp_extract_all(col(text), F.lit(p), F.lit(0)), F.length) for p in ENCODED]))
    return df.withColumns({"max_encoded_data_length": F.coalesce(F.array_max(runs), F.lit(0)).cast("long"), "encoded_data_percent": ratio(F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x), F.length(col(text)))}).drop(runs)


def code_quality(df: DataFrame, text: str = "text", language: str = "lang", tokens: Column | None = None, ends: str = LINE_ENDS) -> DataFrame:
    """All per-file features; `tokens`, a token count, adds char_token_ratio. `ends` is the pattern of line ends."""
    out = encoded_data(line_stats(df, text, ends=ends), text).withColumns({
        "alphanum_frac": alphanumeric_share(text), "alphabetic_percent": alphabetic_percent(text), "autogenerated": is_generated(text, ends=ends), "config_or_test": is_config_or_test(text, ends=ends),
        "has_no_keywords": has_no_keywords(text, language), "has_few_assignments": has_few_assignments(text, language), "is_xml": is_xml(text, language), "is_html": is_html(text, language),
    })
    return out if tokens is None else out.withColumn("char_token_ratio", ratio(F.length(col(text)), tokens))


#: Words that mark licence and copyright lines.
NOTICE = r"(?i)\b(?:licen[sc]ed?\b|copyright\b|\(c\)\s*\d{4}|all rights reserved|spdx-)"


def strip_notices(text: str | Column, pattern: str = NOTICE) -> Column:
    """Without lines that state a licence or copyright, and comment lines left empty next to them."""
    ls = F.split(col(text), "\n")
    bad = lambda x: x.rlike(pattern)
    hollow = lambda x: x.rlike(r"^\s*(?:#|//|/?\*+/?|--|;|<!--|-->)*\s*$") & ~x.rlike(r"^\s*$")
    keep = F.filter(ls, lambda x, i: ~(bad(x) | (hollow(x) & (F.coalesce(bad(F.get(ls, i - 1)), F.lit(False)) | F.coalesce(bad(F.get(ls, i + 1)), F.lit(False))))))
    return F.array_join(keep, "\n")


#: A standard test signature of virus scanners.
EICAR = r"X5O!P%@AP\[4\\PZX54\(P\^\)7CC\)7\}\$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!\$H\+H\*"


def malware(df: DataFrame, text: str = "text", signatures: dict[str, str] | None = None, into: str = "virus_detection") -> DataFrame:
    """Name of the first signature that a text holds, else null. Scanners plug in as further patterns."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(list((signatures or {"Eicar-Signature": EICAR}).items())):
        found = F.when(col(text).rlike(pattern), F.lit(name)).otherwise(found)
    return df.withColumn(into, found)


def dominant_language(df: DataFrame, group: str, language: str = "lang") -> DataFrame:
    """group, language, files: the commonest language; of ties the first by name."""
    counted = df.groupBy(group, language).agg(F.count("*").alias("files"))
    return counted.groupBy(group).agg(F.min_by(F.struct(language, "files"), F.struct(-F.col("files"), language)).alias("m")).select(group, F.col(f"m.{language}").alias("language"), "m.files")


def superrows(df: DataFrame, group: str, order_by: Sequence[str], text: str = "text", language: str = "lang") -> DataFrame:
    """One row per group: its texts in order, joined by line ends, and how many files each language has.

    A group's text is as long as its files together: that is this operator's result, so groups must fit in a row."""
    counts = df.groupBy(group, language).agg(F.count("*").alias("n")).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(language, "n")))).alias("lang_distribution"))
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(text).alias("__t")))).alias("f"), F.count("*").alias("files"))
    return rows.select(group, F.array_join(F.transform("f", lambda x: x["__t"]), "\n").alias("contents"), "files").join(counts, group)


_FIRST = ("readme", "license", "contributing", "changelog")


def path_order(df: DataFrame, path: str, group: str, extensions: Sequence[str] = ("md", "txt", "json", "yaml", "toml", "cfg")) -> DataFrame:
    """Add `place`: within a group by directory, README-like files first, then those of the listed extensions, then the rest, by name."""
    p = col(path)
    folder, name = F.regexp_extract(p, r"^(.*/)?[^/]*$", 1), F.lower(F.regexp_extract(p, r"([^/]*)$", 1))
    kind = F.when(name.rlike("^(?:" + "|".join(_FIRST) + ")"), 0).when(F.regexp_extract(name, r"\.([^.]*)$", 1).isin(list(extensions)), 1).otherwise(2)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(folder, kind, name, p)))


def comment_ratio(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines of code over lines of comment, lines in all, and mean length of functions in lines (by def or function heads)."""
    ls = split_lines(text)
    comments = count_where(ls, lambda x: x.rlike(r"^\s*(?:#|//|/\*|\*|--)"))
    code = count_where(ls, lambda x: ~x.rlike(r"^\s*$")) - comments
    heads = count_where(ls, lambda x: x.rlike(r"^\s*(?:async\s+)?(?:def|function|func|fn)\b"))
    return df.withColumns({"code_comment_ratio": ratio(code, comments), "snippet_lines": F.size(ls).cast("long"), "mean_function_lines": ratio(code, heads)})


def metric_report(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, value, count: how often each value of each metric occurs."""
    kinds = ", ".join(f"'{m}', cast(`{m}` as string)" for m in metrics)
    return df.select(F.expr(f"stack({len(metrics)}, {kinds}) as (metric, value)")).groupBy("metric", "value").agg(F.count("*").alias("count"))
