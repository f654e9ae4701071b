"""Fill-in-middle by relations: matches are posexploded into units, a window sums their lengths up, requests of cuts are joined
to the sums by the ordinal of a unit, a document's offsets are aggregated, and substrings of its text are put in the new order.

Only units' lengths are exploded and shuffled, 16 bytes of key with each; the texts themselves move once, when offsets are joined
to them. Rows are told apart by id and text, so rows that repeat both share their cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: A line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def draws(id_column: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the seed and the id; a null id is spelled as nothing."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _key(id_column: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over id and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit("|"), text).cast("binary"), 256), 1, 32))


def offsets(docs: DataFrame, text: Column, id_column: Column, seed: str, unit: str) -> DataFrame:
    """key, n, prefix_chars, middle_chars of each distinct (id, text); n counts its units."""
    found = F.regexp_extract_all(text, F.lit(unit), F.lit(0))
    # the key first, else each unit would carry the text; outer: a filter of empty texts would match all texts once more
    units = docs.select(_key(id_column, text).alias("key"), F.transform(found, F.length).alias("sizes")).select("key", F.posexplode_outer("sizes").alias("at", "chars"))
    # dealt by key: the same rows of repeated documents meet, and the window needs no further shuffle
    units = units.repartition("key").groupBy("key", "at").agg(F.max("chars").alias("chars"))
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = units.select("key", (F.col("at") + 1).cast("long").alias("ordinal"), F.sum("chars").over(upto).alias("upto"))
    h1, h2, *_ = draws(id_column, seed)
    asked = docs.select(_key(id_column, text).alias("key"), F.size(found).cast("long").alias("n"), h1.alias("h1"), h2.alias("h2"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cuts = F.array(F.struct(F.lit("p").alias("cut"), F.least(a, b).alias("ordinal")), F.struct(F.lit("m").alias("cut"), F.greatest(a, b).alias("ordinal")))
    asked = asked.select("key", "n", F.explode(cuts).alias("q")).select("key", "n", "q.cut", "q.ordinal")
    # a cut before the first unit finds none, and is at 0
    met = asked.join(sums, ["key", "ordinal"], "left")
    end = lambda cut: F.coalesce(F.max(F.when(F.col("cut") == cut, F.col("upto"))), F.lit(0)).cast("long")
    return met.groupBy("key").agg(F.max("n").alias("n"), end("p").alias("prefix_chars"), (end("m") - end("p")).alias("middle_chars"))


def transform(docs: DataFrame, text: str = "text", id_column: str = "doc_id", seed: str = "7", unit: str = LINES, rate: int = 100, spm: int = 50, into: str = "output") -> DataFrame:
    """All columns of `docs`, and n (units), form, prefix_chars, middle_chars (code points; null if plain) and the new text `into`.

    `rate` of a hundred documents are cut, `spm` of a hundred cut ones in the order suffix, prefix, middle; all by hashes of seed
    and id. Null and empty texts are plain with n = 0, as are texts that hold a mark, with their n; a null id draws as an empty
    one; repeated rows come out alike; an empty table stays empty. Columns of these names that `docs` has already are replaced."""
    made = {"n", "form", "prefix_chars", "middle_chars", into}
    names = {*docs.columns, *made}
    key = unused("__key", names)
    t, i = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{id_column}`")
    *_, h3, h4 = draws(i, seed)
    found = offsets(docs, t, i, seed, unit).select(F.col("key").alias(key), *[F.col(c).alias(unused(f"__{c}", names)) for c in ("n", "prefix_chars", "middle_chars")])
    n, p, m = (F.col(f"`{c}`") for c in found.columns[1:])
    both = docs.withColumn(key, _key(i, t)).hint("merge").join(found, key, "left")
    plain = (t == "") | t.rlike(_MARKS) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    one = F.struct(t.alias("t"), p.cast("int").alias("p"), m.cast("int").alias("m"), form.alias("form"))
    part = lambda s, start, size: F.substring(s["t"], start, size)

    def put(s: Column) -> Column:
        before, middle, after = part(s, F.lit(1), s["p"]), part(s, s["p"] + 1, s["m"]), part(s, s["p"] + s["m"] + 1, F.length(s["t"]))
        ordered = F.when(s["form"] == "psm", F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle))
        return F.when(s["form"] == "plain", s["t"]).otherwise(F.coalesce(ordered, F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle)))

    new = {"n": F.coalesce(n, F.lit(0)).cast("long"), "form": form, "prefix_chars": F.when(~plain, p), "middle_chars": F.when(~plain, m), into: put(one)}
    return both.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[c.alias(k) for k, c in new.items()])


def restore(output: Column, form: Column) -> Column:
    """The text again, from what transform() made of it and the form. No text that is cut holds a mark, so marks split it."""
    parts = F.split(output, _MARKS, -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
