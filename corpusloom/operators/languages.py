"""Language identification by character trigrams: counts by language are one aggregate over labelled texts, trigrams are pruned by
their information gain, and the table of log-odds that is left is applied to batches of texts.

The table has at most `most` trigrams, which bounds what the driver and the tasks hold; counts and gains cover all labelled texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..sources.shared import stored


def folded(text: Column) -> Column:
    """Lower case, runs of all but letters one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " "))), F.lit(" "))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams as numbers of three 21-bit characters, the text that each is of)."""
    codes = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64) for t in texts]
    grams = [c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) > 2 else c[:0] for c in codes]
    return (np.concatenate(grams) if grams else np.zeros(0, np.int64)), np.repeat(np.arange(len(grams)), [len(g) for g in grams])


@dataclass(frozen=True)
class Table:
    """Languages, sorted trigrams, their log-odds by language (the last row is for trigrams that aren't listed), and log-priors."""

    languages: tuple[str, ...]
    grams: np.ndarray
    weights: np.ndarray
    priors: np.ndarray


def counted(docs: DataFrame, text: str, language: str) -> DataFrame:
    """language, gram, n over all texts; batches are counted before they are shuffled."""

    def run(batches):
        for b in batches:
            names, at = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True) if b.num_rows else (np.zeros(0, str), np.zeros(0, int))
            grams, of = trigrams(b.column(0).to_pylist())
            for k, name in enumerate(names):
                u, n = np.unique(grams[at[of] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(u)), pa.array(u), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])

    own = docs.where(col(language).isNotNull()).select(folded(col(text)).alias("t"), col(language).cast("string").alias("language"))
    return own.mapInArrow(run, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", language: str = "lang", most: int = 20_000, smoothing: float = 0.5) -> Table:
    """From all rows with a language. Trigrams' gain is the information that one carries about the language: the sum over languages of
    p(gram, language) * ln(p(gram, language) / (p(gram) * p(language))); ties by trigram. Languages are few, a row each on the driver."""
    counts = stored(counted(docs, text, language), "trigrams")
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    docs_of = {r["language"]: r["n"] for r in docs.where(col(language).isNotNull()).groupBy(col(language).cast("string").alias("language")).agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(docs_of))
    if not names:
        raise ValueError("no text has a language")
    every = sum(totals.values())
    n = F.col("n").cast("double")
    per = F.create_map(*[F.lit(x) for name in names for x in (name, float(totals.get(name, 0)))])
    one = counts.withColumn("whole", per[F.col("language")])
    whole = counts.groupBy("gram").agg(F.sum("n").cast("double").alias("all"))
    gained = one.join(whole, "gram").groupBy("gram").agg(F.sum(n / every * F.log(n * every / (F.col("all") * F.col("whole")))).alias("gain"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("by"))
    rows = gained.orderBy(F.desc(F.round("gain", 12)), "gram").limit(most).select("gram", *[F.coalesce(F.col("by")[name], F.lit(0)).alias(f"n{i}") for i, name in enumerate(names)]).toArrow().to_pandas().sort_values("gram")
    grams = rows["gram"].to_numpy(np.int64)
    own = rows.drop(columns="gram").to_numpy(float)
    size = np.array([totals.get(name, 0) for name in names], float)
    share = (np.vstack([own, np.zeros(len(names))]) + smoothing) / (size + smoothing * (len(grams) + 1))
    share[-1] = 1  # others say nothing
    priors = np.log(np.array([docs_of[name] for name in names], float) / sum(docs_of.values()))
    return Table(names, grams, np.log(share), priors)


def identify(df: DataFrame, table: Table, text: str = "text", label: str = "lang_label", score: str = "lang_score") -> DataFrame:
    """Adds the likeliest language and its probability, cut to three decimals; without a listed trigram the commonest language.

    Columns of these names must not exist yet. Null and empty texts have none of the trigrams; repeated rows come out alike."""
    if {label, score} & set(df.columns):
        raise ValueError("label or score column exists already")
    shared, names = df.sparkSession.sparkContext.broadcast(table), df.columns
    own = df.select(*[F.col(f"`{c}`") for c in names], folded(col(text)).alias("__folded"))

    def run(batches):
        t = shared.value
        for b in batches:
            total = np.tile(t.priors, (b.num_rows, 1))
            lo, folds = 0, b.column(len(names))
            while lo < b.num_rows:  # stretches of about a million characters
                hi, size = lo, 0
                while hi < b.num_rows and (size == 0 or size < 1_000_000):
                    size += len(folds[hi].as_buffer())
                    hi += 1
                grams, of = trigrams(folds.slice(lo, hi - lo).to_pylist())
                if len(grams) and len(t.grams):
                    at = np.minimum(np.searchsorted(t.grams, grams), len(t.grams) - 1)
                    known = t.grams[at] == grams
                    np.add.at(total, lo + of[known], t.weights[at[known]])
                lo = hi
            best = total.argmax(axis=1) if b.num_rows else np.zeros(0, int)
            sure = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([t.languages[i] for i in best], pa.string()), pa.array(np.floor(sure * 1000) / 1000)], names=[*names, label, score])

    from pyspark.sql import types as T

    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))
