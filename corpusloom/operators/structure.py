"""HTML text, chunks, tokens, redaction, and model-backed annotators with deterministic offline defaults."""

from __future__ import annotations

import html as html_
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCT, col, once, words

_SKIP = {"script", "style", "noscript", "template", "head", "svg"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "aside", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "main", "form"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "wbr", "area", "base", "col", "embed", "source", "track"}


class _Markdown(HTMLParser):
    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.markdown, self.title = [], 0, markdown, ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title" or self.in_title
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in _BLOCK:
            self.out.append("\n")
            if self.markdown and re.fullmatch(r"h[1-6]", tag):
                self.out.append("#" * int(tag[1]) + " ")
            if self.markdown and tag == "li":
                self.out.append("- ")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _SKIP and self.skip:
            self.skip -= 1
        elif tag in _BLOCK and not self.skip:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_text(page: str | None, markdown: bool = True) -> tuple[str, str]:
    """(title, text or markdown): one line per block, blank ones dropped."""
    p = _Markdown(markdown)
    p.feed(page or "")
    p.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(p.out).split("\n")]
    return html_.unescape(p.title).strip(), "\n".join(x for x in lines if x and x not in ("-", "#"))


def html2parquet(df: DataFrame, page: str = "html", markdown: bool = True) -> DataFrame:
    """Add title, contents, document_id (sha256 of contents) and size; pages come as strings or UTF-8 bytes."""

    @F.pandas_udf("title string, contents string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_to_text(x.decode("utf-8", "replace") if isinstance(x, (bytes, bytearray)) else x, markdown) for x in s], columns=["title", "contents"])

    out = df.withColumn("__r", run(col(page))).select("*", "__r.title", "__r.contents").drop("__r")
    return out.withColumns({"document_id": F.sha2("contents", 256), "size": F.octet_length("contents").cast("long")})


def chunk_words(df: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 128, overlap: int = 30) -> DataFrame:
    """A row per chunk of `size` words that begin size - overlap apart: source_document_id, chunk_id, contents, document_id (sha256)."""
    step = size - overlap
    w = words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__w") - overlap - 1, F.lit(0)), F.lit(step))
    parts = df.withColumn("__w", w).where(F.size("__w") > 0).withColumn("__p", F.transform(starts, lambda i: F.array_join(F.slice(F.col("__w"), i + 1, F.lit(size)), " ")))
    return _chunks(parts.drop("__w"), text, id_column)


def chunk_markdown(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row per section: what begins with a heading, and what lies before the first one."""
    parts = F.filter(F.transform(F.split(col(text), r"(?m)^(?=#{1,6} )"), lambda x: F.trim(F.regexp_replace(x, r"\s+\z", ""))), lambda x: x != "")
    return _chunks(df.withColumn("__p", parts), text, id_column)


def chunk_json(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row per text item of a converted document in JSON, with its path, page and box."""
    kind = "struct<texts: array<struct<self_ref: string, text: string, prov: array<struct<page_no: long, bbox: struct<l: double, t: double, r: double, b: double>>>>>>"
    items = df.select("*", F.posexplode(F.from_json(col(text), kind)["texts"]).alias("chunk_id", "__i")).where(F.length("__i.text") > 0)
    out = items.withColumns({"source_document_id": col(id_column), "contents": F.col("__i.text"), "doc_jsonpath": F.col("__i.self_ref"), "page_number": F.get("__i.prov", F.lit(0))["page_no"], "bbox": F.get("__i.prov", F.lit(0))["bbox"]})
    return out.withColumns({"document_id": F.sha2("contents", 256), "chunk_id": F.col("chunk_id").cast("long")}).drop("__i")


def _chunks(parts: DataFrame, text: str, id_column: str) -> DataFrame:
    # The outer form, since for the other one Spark infers a filter that builds all chunks once more.
    rows = parts.select(*[c for c in parts.columns if c not in (text, "__p", id_column)], col(id_column).alias("source_document_id"), F.posexplode_outer("__p").alias("chunk_id", "contents"))
    return rows.where("contents is not null").withColumns({"chunk_id": F.col("chunk_id").cast("long"), "document_id": F.sha2("contents", 256)})


#: A plain tokenizer: words, numbers and single other marks, of which a vertical tab is one.
TOKEN = r"[A-Za-z]+|[0-9]+|[^ \t\n\f\rA-Za-z0-9]"


def tokenize_regex(df: DataFrame, text: str = "text", id_column: str = "doc_id", pattern: str = TOKEN, keep_empty: bool = False) -> DataFrame:
    """id, tokens, document_length, token_count; null and empty texts go, or with keep_empty stay, with nulls and without tokens."""
    tokens = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))
    own = df if keep_empty else df.where(F.length(col(text)) > 0)
    return own.select(col(id_column), tokens.alias("tokens"), F.length(col(text)).cast("long").alias("document_length")).withColumn("token_count", F.array_size("tokens").cast("long"))


def long_splits(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters, cut after the last space in reach, or hard where there is none."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = text.rfind(" ", at, end)
            end = cut if cut > at else end
        out.append(text[at:end])
        at = end
        while at < len(text) and text[at] == " ":
            at += 1
    return out


def tokenize(df: DataFrame, tokenizer: Callable[[], Callable[[str], list[int]]], text: str = "text", id_column: str = "doc_id", chunk_size: int = 0) -> DataFrame:
    """id, tokens, document_length, token_count with a pluggable tokenizer, made once per worker by the factory. Long texts are
    cut first where chunk_size is set; documents that are empty or that the tokenizer fails on are dropped."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()

        def one(t):
            try:
                return [x for p in (long_splits(t, chunk_size) if chunk_size else [t]) for x in encode(p)] or None
            except Exception:  # the operator's policy: failures are dropped
                return None

        for s in batches:
            yield s.map(one)

    own = df.where(F.length(col(text)) > 0).select(col(id_column), F.length(col(text)).cast("long").alias("document_length"), run(col(text)).alias("tokens"))
    return own.where("tokens is not null").select(id_column, "tokens", "document_length", F.size("tokens").cast("long").alias("token_count"))


def bytes_tokenizer() -> Callable[[str], list[int]]:
    return lambda t: list(t.encode())


def token_totals(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """File totals of a token table: documents and tokens per input file."""
    return tokens.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("docs"), F.sum("token_count").alias("tokens"))


#: Entities by regular expression, in the order in which they are replaced.
ENTITIES = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "PHONE_NUMBER": r"\+?[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "DATE_TIME": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
}


def redact(df: DataFrame, text: str = "text", entities: Sequence[str] = tuple(ENTITIES), replace: bool = True, into: str = "new_contents", models: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Prepend `into`, with entities as <TYPE> (or gone), and detected_pii, the types found. Names and the like need a model: `models` runs first."""
    if models:
        df = models(df)
    # Each step's text is computed once: it is the one element of an array that the next step transforms.
    state = F.array(F.struct(col(text).alias("t"), F.array().cast("array<string>").alias("found")))
    def step(name: str):
        def run(s: Column) -> Column:
            new = F.regexp_replace(s["t"], ENTITIES[name], f"<{name}>" if replace else "")
            return F.when(s["t"].rlike(ENTITIES[name]), F.struct(new.alias("t"), F.array_append(s["found"], F.lit(name)).alias("found"))).otherwise(s)

        return run

    for name in entities:
        state = F.transform(state, step(name))
    rest = [c for c in df.columns if c not in (into, "detected_pii")]
    out = df.withColumn("__s", F.element_at(state, 1))
    return out.select(F.col("__s.t").alias(into), F.col("__s.found").alias("detected_pii"), *rest)


#: Frequent short words by language.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "with"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "von", "den", "ein"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "que", "pour", "dans"),
    "es": ("el", "los", "y", "que", "por", "con", "para", "una", "del", "las"),
}


def lang_id(df: DataFrame, text: str = "text", label: str = "lang_label", score: str = "lang_score", model: Callable[[], Callable[[pd.Series], pd.DataFrame]] | None = None) -> DataFrame:
    """Label and score (cut to 3 decimals). By default the language with most stop words among the words, the first of ties,
    with their share; a model plugs in as a factory of batch scorers. Columns of these names must not exist yet."""
    if {label, score} & set(df.columns):
        raise ValueError("label or score column exists already")
    if model is not None:

        @F.pandas_udf("label string, score double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            predict = model()
            for s in batches:
                yield predict(s.fillna("").str.replace("\n", " "))

        return df.withColumn("__m", run(col(text))).select("*", F.col("__m.label").alias(label), (F.floor(F.col("__m.score") * 1000) / 1000).alias(score)).drop("__m")
    given = df.columns
    df, w = once(df, "words", F.transform(words(F.lower(col(text))), lambda x: F.regexp_replace(x, f"[{PUNCT}]", "")))

    def among(listed: Sequence[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(list(listed))))

    df, n = once(df, "counts", F.struct(*[among(listed).alias(lang) for lang, listed in STOP_WORDS.items()]))
    best, name = F.greatest(*[n[lang] for lang in STOP_WORDS]), F.lit(None).cast("string")
    for lang in reversed(STOP_WORDS):
        name = F.when(n[lang] == best, lang).otherwise(name)
    share = F.when(F.size(w) > 0, best / F.size(w)).otherwise(0.0)
    return df.select(*[F.col(f"`{c}`") for c in given], F.when(best > 0, name).otherwise(F.lit("unknown")).alias(label), (F.floor(1000 * share) / 1000).alias(score))


def classify(df: DataFrame, models: Sequence[tuple[Callable[[], Callable[[pd.Series], pd.DataFrame]], str, str]], text: str = "text") -> DataFrame:
    """A label and a score column for each (factory, label, score); each model is made once per worker."""
    for factory, label, score in models:
        df = lang_id(df, text, label, score, factory)
    return df


class HashedLogistic:
    """Logistic regression on hashed words, learned offline from a bounded sample; a stand-in for an external classifier."""

    def __init__(self, bits: int = 14, rate: float = 0.5, passes: int = 5):
        self.bits, self.rate, self.passes = bits, rate, passes
        self.w = np.zeros(1 << bits)

    def _row(self, t: str) -> np.ndarray:
        return np.unique([xxhash.xxh32_intdigest(w) & ((1 << self.bits) - 1) for w in t.lower().split()]).astype(np.int64)

    def fit(self, texts: Sequence[str], labels: Sequence[int]) -> HashedLogistic:
        rows = [self._row(t) for t in texts]
        for _ in range(self.passes):
            for r, y in zip(rows, labels, strict=True):
                if len(r):
                    self.w[r] += self.rate * (y - 1 / (1 + np.exp(-self.w[r].sum()))) / np.sqrt(len(r))
        return self

    def scorer(self, yes: str = "1", no: str = "0") -> Callable[[pd.Series], pd.DataFrame]:
        def run(s: pd.Series) -> pd.DataFrame:
            p = np.array([1 / (1 + np.exp(-np.clip(self.w[self._row(t)].sum(), -50, 50))) for t in s])
            return pd.DataFrame({"label": np.where(p >= 0.5, yes, no), "score": np.maximum(p, 1 - p)})

        return run


#: Rude words of the offline scorer.
RUDE = ("idiot", "moron", "worthless", "trash", "pathetic", "disgusting", "clown", "loser")


def hap(df: DataFrame, text: str = "text", into: str = "hap_score", model: Callable[[], Callable[[pd.Series], pd.Series]] | None = None) -> DataFrame:
    """Highest score of a text's sentences; 0 for the empty text. By default a sentence's score is the share of rude words."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model() if model else _rude_share
        for s in batches:
            split = s.fillna("").map(lambda t: [x for x in re.split(r"(?<=[.!?])\s+|\n+", t) if x])
            flat = split.explode().dropna()
            yield score(flat).groupby(level=0).max().reindex(s.index).fillna(0.0) if len(flat) else pd.Series(0.0, s.index)

    return df.withColumn(into, run(col(text)))


def _rude_share(s: pd.Series) -> pd.Series:
    def one(t: str) -> float:
        ws = re.findall(r"[a-z]+", t.lower())
        return sum(w in RUDE for w in ws) / len(ws) if ws else 0.0

    return s.map(one).astype("float64")


def text_encoder(df: DataFrame, text: str = "text", into: str = "embeddings", size: int = 256, model: Callable[[], Callable[[pd.Series], list]] | None = None) -> DataFrame:
    """L2-normalised vectors. By default hashed term frequencies with signs."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model() if model else (lambda s: [_hashed(t, size) for t in s])
        for s in batches:
            rows = [np.asarray(v, np.float32) for v in encode(s.fillna(""))]
            yield pd.Series([(v / (np.linalg.norm(v) or 1)).astype(np.float32) for v in rows])

    return df.withColumn(into, run(col(text)))


def _hashed(t: str, size: int) -> np.ndarray:
    v = np.zeros(size, np.float32)
    for w in t.lower().split():
        h = xxhash.xxh64_intdigest(w)
        v[h % size] += 1 if h >> 63 else -1
    return v


def html_converter(raw: bytes, path: str) -> dict:
    """A converter for docling2parquet: an HTML file as one page of markdown."""
    page = raw.decode("utf-8", "replace")
    return {"contents": html_to_text(page)[1], "num_pages": 1, "num_tables": len(re.findall(r"<table\b", page, re.I))}


def split_counts(df: DataFrame, text: str = "text", size: int = 4000, into: str = "pieces") -> DataFrame:
    """Into how many pieces long_splits cuts each text."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: len(long_splits(t, size)))

    return df.withColumn(into, run(col(text)))


#: What an external converter of office documents must do; none is installed, so callers register theirs.
Converter = Callable[[bytes, str], dict]


def docling2parquet(files: DataFrame, converter: Converter, content: str = "content", path: str = "path") -> DataFrame:
    """Converted documents: path, contents, num_pages, num_tables, document_id; files that fail to convert are dropped."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf[path], pdf[content], strict=True):
                try:
                    d = converter(bytes(c), p)
                    rows.append((p, d["contents"], int(d.get("num_pages", 0)), int(d.get("num_tables", 0))))
                except Exception:  # the operator's policy: a file that fails gives no row
                    continue
            yield pd.DataFrame(rows, columns=["path", "contents", "num_pages", "num_tables"])

    out = files.select(path, content).mapInPandas(run, "path string, contents string, num_pages long, num_tables long")
    return out.withColumn("document_id", F.sha2("contents", 256))


#: type -> loader of models, for plug-ins that name a model by type and path.
LOADERS: dict[str, Callable[[str], object]] = {}


def register_loader(kind: str, loader: Callable[[str], object]) -> None:
    LOADERS[kind] = loader


def load_model(kind: str, path: str) -> object:
    if kind not in LOADERS:
        raise ValueError(f"no loader for models of type {kind}")
    return LOADERS[kind](path)
