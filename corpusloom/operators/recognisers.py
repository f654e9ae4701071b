"""Personal data by recognisers: a pattern, a check of what it matches, and words before it that make it likelier. Overlapping finds
are settled by weighted interval scheduling: of all sets of finds that don't overlap, the one of the greatest total score stays.

Names of persons and the like need a model; recognisers of any kind plug in as further entries, and spans that a model has found
can be passed to resolve()."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: The score from which a find counts, what a context word adds, the least score with one, and how many words before count.
THRESHOLD, BOOST, LEAST_WITH_CONTEXT, WORDS_BEFORE = 0.6, 0.35, 0.4, 5
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_FREE = r"(?<![\w.+-])"


def luhn(found: str) -> bool:
    digits = [int(c) for c in reversed(found) if c.isdigit()]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


#: Lengths of account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def iban(found: str) -> bool:
    """The country's length, and 1 as the rest of the number by 97."""
    s = found.replace(" ", "").upper()
    return IBAN_LENGTHS.get(s[:2]) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def date(found: str) -> bool:
    import datetime as dt

    try:
        dt.date.fromisoformat(found[:10])
    except ValueError:
        return False
    return True


def ssn(found: str) -> bool:
    a, b, c = found.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


@dataclass(frozen=True)
class Recogniser:
    """score: of a match; check: what it must pass, with 1.0 as its score then where `sure`; context: lower-case words."""

    entity: str
    pattern: str
    score: float
    check: Callable[[str], bool] | None = None
    sure: bool = False
    context: frozenset[str] = frozenset()

    def find(self, text: str):
        """(first, last, entity, score); of a number that fails its check nothing."""
        for m in re.finditer(self.pattern, text):
            if self.check and not self.check(m[0]):
                continue
            score = 1.0 if self.check and self.sure else self.score
            if self.context and score < 1:
                before = re.findall(r"\w+", text[max(0, m.start() - 100) : m.start()].lower())[-WORDS_BEFORE:]
                if self.context.intersection(before):
                    score = max(min(1.0, score + BOOST), LEAST_WITH_CONTEXT)
            yield m.start(), m.end(), self.entity, score


RECOGNISERS = (
    Recogniser("EMAIL_ADDRESS", r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}", 1.0),
    Recogniser("CREDIT_CARD", rf"{_FREE}[1-9](?:[ -]?\d){{12,18}}(?![\w-])", 0.3, luhn, True, frozenset({"card", "credit", "visa", "mastercard", "amex", "debit"})),
    Recogniser("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5, iban, True),
    Recogniser("PHONE_NUMBER", rf"{_FREE}(?:\+?\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?![\w-])", 0.4, None, False, frozenset({"phone", "call", "tel", "telephone", "mobile", "cell", "fax", "number"})),
    Recogniser("PHONE_NUMBER", rf"{_FREE}\+\d{{1,3}}[ .-]?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?![\w-])", 0.75),
    Recogniser("US_SSN", rf"{_FREE}\d{{3}}-\d{{2}}-\d{{4}}(?![\w-])", 0.5, ssn, False, frozenset({"ssn", "social", "security"})),
    Recogniser("IP_ADDRESS", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)", 0.6),
    Recogniser("DATE_TIME", rf"{_FREE}\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?)?(?![\w-])", 0.6, date),
    Recogniser("PERSON", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", 0.6),
    Recogniser("ORGANIZATION", r"\b[A-Z]\w+(?: [A-Z]\w+){0,3} (?:Inc|Ltd|LLC|GmbH|Corp|AG|SE)\b\.?", 0.6),
)


def resolve(spans: Sequence[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The spans of the greatest total score that don't overlap, in the order of the text. Of equal totals more characters, then the
    earlier in the order of (end, start, entity) hold. Scores count to six places."""
    rows = sorted({(b, a, e, round(s * 10**6)) for a, b, e, s in spans})
    ends = [r[0] for r in rows]
    best: list[tuple[int, int]] = [(0, 0)]
    for i, (b, a, _, s) in enumerate(rows):
        total, chars = best[bisect_right(ends, a, 0, i)]
        best.append(max(best[-1], (total + s, chars + b - a)))
    out, i = [], len(rows)
    while i:
        b, a, e, s = rows[i - 1]
        j = bisect_right(ends, a, 0, i - 1)
        if best[i] != best[i - 1]:
            out.append((a, b, e, s / 10**6))
            i = j
        else:
            i -= 1
    return out[::-1]


def finds(text: str | None, recognisers: Sequence[Recogniser], threshold: float) -> list[tuple[int, int, str, float]]:
    """What stays of all recognisers' finds that reach the threshold."""
    return resolve([f for r in recognisers for f in r.find(text) if f[3] >= threshold]) if text else []


def _chosen(entities: Sequence[str] | None, recognisers: Sequence[Recogniser]) -> list[Recogniser]:
    return [r for r in recognisers if entities is None or r.entity in entities]


def detect(df: DataFrame, text: str = "text", id_column: str = "doc_id", entities: Sequence[str] | None = None, threshold: float = THRESHOLD, recognisers: Sequence[Recogniser] = RECOGNISERS) -> DataFrame:
    """id, first, last (exclusive, code points), entity, score, found of all entities. Null and empty texts have none; repeated rows
    give theirs each."""
    used, own = _chosen(entities, recognisers), df.select(col(id_column).alias("id"), col(text).alias("text"))
    names, kinds = ["first", "last", "entity", "score", "found"], [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for a, z, e, s in finds(t, used, threshold):
                    at.append(i)
                    rows.append((a, z, e, s, t[a:z]))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    return own.mapInArrow(run, f"id {own.dtypes[0][1]}, first long, last long, entity string, score double, found string")


def redact(df: DataFrame, text: str = "text", entities: Sequence[str] | None = None, threshold: float = THRESHOLD, replace: bool = True, into: str = "new_contents", recognisers: Sequence[Recogniser] = RECOGNISERS) -> DataFrame:
    """All columns, `into` with entities as <ENTITY> (or gone), and detected_pii, the entities found in the order of the text. Columns
    of these names are replaced. Null texts stay null and have a null list; empty ones an empty list."""
    used, kept = _chosen(entities, recognisers), [c for c in df.columns if c not in (into, "detected_pii")]
    own = df.select(*[F.col(f"`{c}`") for c in kept], col(text).cast("string").alias(into))

    def run(batches):
        for b in batches:
            new, told = [], []
            for t in b.column(len(kept)).to_pylist():
                found, at, parts = finds(t, used, threshold), 0, []
                for a, z, e, _ in found:
                    parts += [t[at:a], f"<{e}>" if replace else ""]
                    at = z
                new.append(None if t is None else "".join([*parts, t[at:]]))
                told.append(None if t is None else [f[2] for f in found])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(new, pa.string()), pa.array(told, pa.list_(pa.string()))], names=[*kept, into, "detected_pii"])

    from pyspark.sql import types as T

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("detected_pii", T.ArrayType(T.StringType()))]))
