"""Features of texts: words, lines, repetition, readability, enrichment. Null texts give null features; empty ones 0.

What no built-in function expresses (order-dependent scans, Unicode normal forms) runs in Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import rolling
from ..functions.text import WS, PUNCT, col, count_of, count_where, lines, n_words, once, ratio, total_length, without, words

#: Symbols, bullets, common English words, ends of sentences.
SYMBOLS = ("#", "...")
BULLETS = ("-", "*")
COMMON_EN = ("the", "and", "to", "that", "of", "with", "be", "have")
END_PUNCTUATION = (".", "?", "!", '"', "'")
#: Fixed values of enrichment: ends of paragraphs, an ellipsis near the end of one, marks of list items.
PARAGRAPH_ENDS = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+"
ELLIPSIS = r"(?:\.\.\.|\. \. \.|…).{0,15}\s*$"
BULLET_POINTS = ("●", "•", "*", "-")


def word_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    df, w = once(df, "words", words(text))
    n = F.size(w).cast("long")
    return df.withColumns({
        "docq_total_words": n,
        "docq_mean_word_len": ratio(total_length(w), n),
        "docq_symbol_to_word_ratio": ratio(count_where(w, lambda x: x.contains(SYMBOLS[0]) | x.contains(SYMBOLS[1])), n),
    }).drop(w)


def line_ratios(df: DataFrame, text: str = "text") -> DataFrame:
    df, ls = once(df, "lines", lines(text))
    df, w = once(df, "words", words(text))
    return df.withColumns({
        "docq_bullet_point_ratio": ratio(count_where(ls, lambda x: x.startswith(BULLETS[0]) | x.startswith(BULLETS[1])), F.size(ls)),
        "docq_ellipsis_line_ratio": ratio(count_where(ls, lambda x: x.endswith("...")), F.size(ls)),
        "docq_alphabet_word_ratio": ratio(count_where(w, lambda x: x.rlike(r"\p{L}")), F.size(w)),
    }).drop(ls, w)


def sentence_count(text: str | Column, lang: str = "en") -> Column:
    """Japanese full stops, else runs that begin at a word and end before or after .!? marks."""
    if lang == "ja":
        return count_of(text, "。")
    return F.regexp_count(col(text), F.lit(r"(?U)\b[^.!?]+[.!?]*")).cast("long")


def lorem_ipsum_ratio(text: str | Column) -> Column:
    """Occurrences over the length of the text without punctuation, in lower case and with single spaces."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(without(text, f"[{PUNCT}]")), WS + "+", " ")), "^ | $", "")
    return ratio(count_of(plain, "lorem ipsum"), F.length(plain))


def curly_bracket_ratio(text: str | Column) -> Column:
    return ratio(count_of(text, "{") + count_of(text, "}"), F.length(col(text)))


def contains_bad_word(text: str | Column, bad_words: Sequence[str]) -> Column:
    """Any of the words as a whole, whatever its case; blank entries are dropped."""
    listed = [re.escape(w.strip()) for w in bad_words if w.strip()]
    return col(text).rlike(r"(?iU)\b(?:" + "|".join(listed) + r")\b") if listed else F.lit(False)


def contains_common_words(text: str | Column, lang: Column | str = "en", least: int = 2) -> Column:
    """At least `least` of the common English words as substrings; only for English."""
    n = sum((F.contains(col(text), F.lit(w)).cast("int") for w in COMMON_EN), F.lit(0))
    return (F.lit(lang) if isinstance(lang, str) else lang).eqNullSafe("en") & (n >= least)


def japanese(df: DataFrame, text: str = "text") -> DataFrame:
    """Mean length of sentences, and the place of the first kana (-1: none)."""
    n = count_of(text, "。")
    return df.withColumns({
        "docq_avg_ja_sentence_len": F.when(n == 0, F.length(col(text))).otherwise(F.floor(F.length(col(text)) / n)).cast("long"),
        "docq_first_ja_alphabet_pos": (F.regexp_instr(col(text), F.lit("[ぁ-んァ-ン]")) - 1).cast("long"),
    })


def doc_quality(df: DataFrame, text: str = "text", lang: str = "en", bad_words: Sequence[str] = ()) -> DataFrame:
    out = line_ratios(word_statistics(df, text), text).withColumns({
        "docq_sentence_count": sentence_count(text, lang),
        "docq_lorem_ipsum_ratio": lorem_ipsum_ratio(text),
        "docq_curly_bracket_ratio": curly_bracket_ratio(text),
        "docq_contain_bad_word": contains_bad_word(text, bad_words),
        "docq_contain_common_en_words": contains_common_words(text, lang),
    })
    return japanese(out, text) if lang == "ja" else out


def normalise(text: str | Column, language: str | Column = "en", accents: bool = True, lower: bool = True, digits: bool = True, punctuation: int = 1) -> Column:
    """Strip, take the language's normal form (ja: NFKC, en: NFD, others: as it is), lower-case, drop marks without a width, digits to 0,
    typographic marks to plain ones (punctuation 1) or none (2; 0: stay), no control characters, line ends included.

    `language`: a column, or the language of all texts. Null texts stay null, a null language is none of the two."""

    @F.pandas_udf("string")
    def run(s: pd.Series, languages: pd.Series) -> pd.Series:
        def one(t, lang):
            if t is None:
                return None
            t = t.strip()
            t = unicodedata.normalize("NFKC", t) if lang == "ja" else unicodedata.normalize("NFD", t) if lang == "en" else t
            t = t.lower() if lower else t
            t = "".join(c for c in t if unicodedata.category(c) != "Mn") if accents else t
            t = re.sub(r"\d", "0", t) if digits else t
            t = t.translate(PLAIN if punctuation == 1 else dict.fromkeys(PLAIN)) if punctuation else t
            return _CONTROLS.sub("", t)

        return pd.Series([one(t, lang) for t, lang in zip(s, languages, strict=True)], dtype=object)

    return run(col(text), F.lit(language) if isinstance(language, str) else language)


_CONTROLS = re.compile("[\x00-\x1f\x7f-\x9f]")
#: Typographic punctuation and its plain form.
PLAIN = str.maketrans({
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!",
    "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
})


def _repeated(items: Column) -> tuple[Column, Column]:
    """(number, characters) of the items that occurred before."""
    return (F.size(items) - F.size(F.array_distinct(items))).cast("long"), total_length(items) - total_length(F.array_distinct(items))


def repeated_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Shares of repeated lines and paragraphs, by number and by characters. Closed forms: what remains after a distinct."""
    df, ls = once(df, "lines", F.split(col(text), "\n+"))
    df, ps = once(df, "paragraphs", F.split(F.regexp_replace(col(text), r"^\s+|\s+$", ""), "\n{2,}"))
    (ln, lc), (pn, pc) = _repeated(ls), _repeated(ps)
    size = F.length(col(text))
    return df.withColumns({"dup_line_frac": ratio(ln, F.size(ls)), "dup_line_char_frac": ratio(lc, size), "dup_para_frac": ratio(pn, F.size(ps)), "dup_para_char_frac": ratio(pc, size)}).drop(ls, ps)


class Grams:
    """n-grams of a list of words by 64-bit hashes: of the words in order, or of their characters without the spaces."""

    def __init__(self, ws: Sequence[str]):
        self.sizes = np.fromiter(map(len, ws), np.int64, len(ws))
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        number: dict[str, int] = {}
        self.by_word = rolling(np.array([number.setdefault(w, len(number)) + 1 for w in ws], np.uint64))
        self.by_character = rolling(np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))

    def top_chars(self, n: int) -> int:
        """Characters, spaces included, of all occurrences of the commonest n-gram; of equally common ones the first."""
        first = np.arange(len(self.sizes) - n + 1)
        if not len(first):
            return 0
        _, at, times = np.unique(self.by_word(first, first + n), return_index=True, return_counts=True)
        most = times.max()
        at = int(at[times == most].min())
        return int(self.ends[at + n] - self.ends[at] + n - 1) * int(most)

    def repeated_chars(self, n: int) -> int:
        """Characters of n-grams met before, reading from left to right and skipping past each repeat."""
        first = np.arange(len(self.sizes) - n + 1)
        if not len(first):
            return 0
        keys = self.by_character(self.ends[first], self.ends[first + n])
        if len(np.unique(keys)) == len(keys):
            return 0
        seen, total, i, keys = set(), 0, 0, keys.tolist()
        while i < len(keys):
            if keys[i] in seen:
                total, i = total + int(self.ends[i + n] - self.ends[i]), i + n
            else:
                seen.add(keys[i])
                i += 1
        return total


def gram_repetition(df: DataFrame, text: str = "text", tokenize: Callable[[str], list[str]] = str.split) -> DataFrame:
    """top_{2..4}_gram_char_frac and dup_{5..10}_gram_char_frac, over the characters of the text."""
    names = [f"top_{n}_gram_char_frac" for n in (2, 3, 4)] + [f"dup_{n}_gram_char_frac" for n in range(5, 11)]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            g = Grams(tokenize(t) if t else [])
            rows.append([None] * 9 if t is None else [0.0] * 9 if not t else [g.top_chars(n) / len(t) for n in (2, 3, 4)] + [g.repeated_chars(n) / len(t) for n in range(5, 11)])
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return df.withColumn("__r", run(col(text))).select("*", *[F.col(f"__r.{n}").alias(n) for n in names]).drop("__r")


def line_quality(df: DataFrame, text: str = "text", short: int = 30) -> DataFrame:
    """Shares of lines that end in punctuation, are short, repeat (by characters), and line ends per word."""
    df, ls = once(df, "lines", lines(text))
    full = F.filter(ls, lambda x: ~x.rlike(r"^\s*$"))
    ends = lambda x: x.endswith(END_PUNCTUATION[0]) | x.endswith(END_PUNCTUATION[1]) | x.endswith(END_PUNCTUATION[2]) | x.endswith(END_PUNCTUATION[3]) | x.endswith(END_PUNCTUATION[4])
    return df.withColumns({
        "frac_line_punct": ratio(count_where(ls, ends), F.size(ls)),
        "short_line_frac": ratio(count_where(ls, lambda x: F.length(x) <= short), F.size(ls)),
        "dup_line_char_frac": ratio(_repeated(full)[1], F.length(col(text)) - count_of(text, "\n")),
        "new_line_ratio": ratio(count_of(text, "\n"), n_words(text)),
    }).drop(ls)


_VOWELS = "[aeiouy]+"


def syllables(word: Column) -> Column:
    """Groups of vowels, without a silent e at the end; one at least."""
    return F.greatest(F.regexp_count(F.lower(word), F.lit(_VOWELS)) - F.lower(word).rlike("[^aeiouyl]e$").cast("int"), F.lit(1))


def readability(df: DataFrame, text: str = "text", scores: Sequence[str] = ("mcalpine_eflaw",), easy_words: Sequence[str] = COMMON_EN) -> DataFrame:
    """Published readability formulas, by name. Words are white-space runs, sentences as in sentence_count (one at least).

    difficult_words are words of two syllables or more that aren't in `easy_words`, for which callers pass the published list;
    Dale-Chall's and Spache's scores depend on it. text_standard is the grade that most of the other scores give, rounded and
    rounded up; of equally frequent grades the first in the order of the published consensus."""
    w = F.transform(words(text), lambda x: F.regexp_replace(x, f"^[{PUNCT}]+|[{PUNCT}]+$", ""))
    base = df.withColumn("__w", F.filter(w, lambda x: x != "")).withColumn("__n", F.greatest(F.size("__w"), F.lit(1)).cast("double")).withColumn("__s", F.greatest(sentence_count(text), F.lit(1)).cast("double"))
    base = base.withColumn("__y", F.transform("__w", syllables)).withColumn("__ch", total_length(F.col("__w")).cast("double"))
    n, s, ch = F.col("__n"), F.col("__s"), F.col("__ch")
    sy = F.aggregate(F.col("__y"), F.lit(0), lambda a, x: a + x)
    poly = F.size(F.filter("__y", lambda x: x >= 3))
    hard = F.size(F.filter(F.arrays_zip("__w", "__y"), lambda x: (x["__y"] >= 2) & ~F.lower(x["__w"]).isin(list(easy_words))))
    mini = F.size(F.filter("__w", lambda x: F.length(x) <= 3))
    kincaid, fog = 0.39 * n / s + 11.8 * sy / n - 15.59, 0.4 * (n / s + 100.0 * poly / n)
    smog = F.when(s >= 3, 1.043 * F.sqrt(30.0 * poly / s) + 3.1291).otherwise(0.0)
    coleman = 0.0588 * (ch / n * 100) - 0.296 * (s / n * 100) - 15.8
    ari = 4.71 * ch / n + 0.5 * n / s - 21.43
    dale = 0.1579 * (100.0 * hard / n) + 0.0496 * n / s + F.when(100.0 * hard / n > 5, 3.6365).otherwise(0.0)
    linsear0 = (n - poly + 3.0 * poly) / s
    linsear = F.when(linsear0 > 20, linsear0 / 2).otherwise((linsear0 - 2) / 2)
    ease = 206.835 - 1.015 * n / s - 84.6 * sy / n
    two = lambda x: F.array(F.round(x).cast("int"), F.ceil(x).cast("int"))
    bands = F.when((ease < 100) & (ease >= 90), F.array(F.lit(5)))
    for low, grades in ((80, (6,)), (70, (7,)), (60, (8, 9)), (50, (10,)), (40, (11,)), (30, (12,))):
        bands = bands.when((ease < low + 10) & (ease >= low), F.array(*map(F.lit, grades)))
    grades = F.concat(two(kincaid), bands.otherwise(F.array(F.lit(13))), *[two(x) for x in (smog, coleman, ari, dale, linsear, fog)])
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    standard = let(grades, lambda g: let(F.transform(g, lambda x: F.size(F.filter(g, lambda y: y == x))), lambda c: F.element_at(g, F.array_position(c, F.array_max(c)).cast("int"))))
    known = {
        "flesch_ease": 206.835 - 1.015 * n / s - 84.6 * sy / n, "flesch_kincaid": kincaid, "gunning_fog": fog, "smog_index": smog, "coleman_liau_index": coleman,
        "automated_readability_index": ari, "dale_chall_readability_score": dale, "difficult_words": hard.cast("double"), "linsear_write_formula": linsear,
        "text_standard": standard.cast("double"), "spache_readability": 0.121 * n / s + 0.082 * (100.0 * hard / n) + 0.659,
        "mcalpine_eflaw": (n + mini) / s, "reading_time": F.length(F.regexp_replace(col(text), r"\s", "")) * 14.69 / 1000,
    }
    return base.withColumns({f"{k}_textstat": known[k] for k in scores}).drop("__w", "__n", "__s", "__y", "__ch")


SCORES = ("flesch_ease", "flesch_kincaid", "gunning_fog", "smog_index", "coleman_liau_index", "automated_readability_index", "dale_chall_readability_score", "difficult_words", "linsear_write_formula", "text_standard", "spache_readability", "mcalpine_eflaw", "reading_time")


def enrichment(df: DataFrame, text: str = "text", tokenize: Callable[[str], list[str]] = str.split) -> DataFrame:
    """Counts, means, character-class ratios and repetition of paragraphs and n-grams. Rows that fail get zeros, a mean
    word length of -1 and the error's text."""
    t = col(text)
    given = df.columns
    df, ps = once(df, "paragraphs", F.filter(F.split(t, PARAGRAPH_ENDS), lambda p: p != ""))
    df, flat = once(df, "flat", F.regexp_replace(t, PARAGRAPH_ENDS, ""))
    n, k, chars = n_words(text).cast("long"), F.size(ps).cast("long"), F.length(flat).cast("long")
    share = lambda p: ratio(F.regexp_count(flat, F.lit(p)), chars)
    out = df.withColumns({
        "num_newlines": (F.length(t) - chars).cast("long"), "num_paragraphs": k, "num_words": n, "num_chars": F.length(t).cast("long"), "total_non_newline_chars": chars,
        "avg_word_length": ratio(F.length(F.regexp_replace(t, WS, "")), n), "avg_paragraph_length_chars": ratio(chars, k), "avg_paragraph_length_words": ratio(n, k),
        "alphanumeric_char_ratio": share(r"[\p{L}\p{N}]"), "control_char_ratio": share(r"[\p{C}&&[^\t]]"), "punctuation_char_ratio": share(r"\p{P}"), "other_symbol_char_ratio": share(r"\p{S}"),
        "tabs_word_ratio": ratio(count_of(text, "\t"), n), "hashes_word_ratio": ratio(count_of(text, "#"), n),
        "ellipsis_ratio": ratio(count_where(ps, lambda p: p.rlike(ELLIPSIS)), k), "bulletpoint_ratio": ratio(count_where(ps, lambda p: p.rlike(r"^\s*[" + "".join(BULLET_POINTS) + "]")), k),
    }).drop(ps, flat)
    names = ["dup_paragraphs_ratio", "dup_paragraphs_char_ratio"] + [f"top_{n}_gram_char_ratio" for n in (2, 3, 4)] + [f"dup_{n}_gram_char_ratio" for n in range(5, 11)]

    @F.pandas_udf(", ".join(f"{x} double" for x in names) + ", error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text_ in s:
            try:
                rows.append([*_enriched(text_ or "", tokenize), None])
            except Exception as e:  # the operator's policy: a row that fails is marked
                rows.append([0.0] * len(names) + [str(e)])
        return pd.DataFrame(rows, columns=[*names, "error"])

    out = out.withColumn("__r", run(t))
    out = out.select("*", *[F.col(f"__r.{x}").alias(x) for x in [*names, "error"]]).drop("__r")
    if tokenize is str.split:  # which can't fail: counts alone then need no Python
        return out
    failed = F.col("error").isNotNull()
    zero = [c for c in out.columns if c not in (*given, "error", "avg_word_length")]
    out = out.withColumns({c: F.when(failed, F.lit(0).cast(dict(out.dtypes)[c])).otherwise(F.col(c)) for c in zero})
    return out.withColumn("avg_word_length", F.when(failed, -1.0).otherwise(F.col("avg_word_length")))


def _enriched(text: str, tokenize) -> list[float]:
    paragraphs, all_words = [], []
    for p in filter(None, re.split("[\n\v\f\r\x85\u2028\u2029]+", text)):
        ws = [x for x in ("".join(c for c in w.lower() if not unicodedata.category(c).startswith("P")) for w in tokenize(p)) if x]
        if ws:
            all_words += ws
            paragraphs.append(" ".join(ws))
    size, total = sum(map(len, paragraphs)), sum(map(len, all_words))
    again, g = _again(paragraphs), Grams(all_words)
    share = lambda a, b: a / b if b else 0.0
    return [share(len(again), len(paragraphs)), share(sum(map(len, again)), size), *[share(g.top_chars(n), total) for n in (2, 3, 4)], *[share(g.repeated_chars(n), total) for n in range(5, 11)]]


def _again(items: list[str]) -> list[str]:
    seen: set[str] = set()
    return [x for x in items if x in seen or seen.add(x)]


_PLAIN_SCRIPT = rf"[\s\d{PUNCT}]|\p{{P}}"


def script_ratio(text: str | Column, script: str) -> Column:
    """Share of a script's characters ("Han", "Arabic", ...) besides white space, punctuation and digits. "CJK" is Han, kana and Hangul."""
    kinds = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]" if script == "CJK" else rf"\p{{Is{script}}}"
    rest = without(text, _PLAIN_SCRIPT)
    return ratio(F.regexp_count(rest, F.lit(kinds)), F.length(rest))


def longest_cjk_segment(text: str | Column) -> Column:
    """Most CJK characters in a run without white space."""
    segments = words(F.regexp_replace(col(text), rf"[\d{PUNCT}]|\p{{P}}", ""))
    return F.coalesce(F.array_max(F.transform(segments, lambda s: F.regexp_count(s, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")))), F.lit(0)).cast("long")


def line_jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two lines' words, without case, punctuation and digits; 1 for two empty lines."""
    w = lambda c: F.array_distinct(words(F.lower(without(c, rf"[\d{PUNCT}]|\p{{P}}"))))
    union = F.size(F.array_union(w(a), w(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(w(a), w(b))) / union)


def punctuation_ratio(text: str | Column) -> Column:
    """Punctuation over other characters that aren't white space; 1 without any."""
    other = F.length(without(text, r"\s|\p{P}"))
    return F.when(other == 0, 1.0).otherwise(F.regexp_count(col(text), F.lit(r"\p{P}")) / other)


def character_repetition(text: str | Column) -> Column:
    """Length of the longest run of one character, digits and white space apart."""
    runs = F.regexp_extract_all(without(text, r"\d"), F.lit(r"((\S)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def clean_line(text: str | Column) -> Column:
    """Without control characters and replacement marks, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(without(text, r"[\p{Cc}&&[^\t\n]]|\x{FFFD}"), r"\s+", " "))


def most_common_token(df: DataFrame, text: str = "text", id_column: str = "doc_id", least: int = 5) -> DataFrame:
    """id, token, share: the commonest word of each text of at least `least` words; of ties the alphabetically first."""
    rows = df.select(col(id_column).alias("id"), words(text).alias("w")).where(F.size("w") >= least)
    # The outer form, since for the other one Spark infers a filter that splits the text again.
    tokens = rows.select("id", F.size("w").alias("n"), F.explode_outer("w").alias("token"))
    counted = tokens.groupBy("id", "token").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return counted.groupBy("id").agg(F.max("k").alias("k"), F.min_by("token", F.struct(-F.col("k"), "token")).alias("token"), F.first("n").alias("n")).select("id", "token", (F.col("k") / F.col("n")).alias("share"))


def extreme_tokenized(docs: DataFrame, tokens: DataFrame, text: str = "text", id_column: str = "doc_id", count: str = "token_count") -> DataFrame:
    """Documents with their token count, size in KB, characters, and tokens per byte and character; null and empty texts go."""
    joined = docs.where(F.length(col(text)) > 0).join(tokens.select(col(id_column).alias("__id"), col(count).cast("long").alias("doc_num_tokens")), col(id_column) == F.col("__id")).drop("__id")
    size, chars = F.octet_length(col(text)), F.length(col(text))
    return joined.withColumns({"doc_size_kbs": size / 1024, "doc_num_chars": chars.cast("long"), "tokens_per_doc_size": F.col("doc_num_tokens") / size, "tokens_per_doc_num_chars": F.col("doc_num_tokens") / chars})


def word_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Corpus-wide counts of words in lower case without ASCII punctuation."""
    plain = F.explode(words(without(F.lower(col(text)), f"[{PUNCT}]"))).alias("word")
    return df.select(plain).groupBy("word").agg(F.count("*").alias("count"))
