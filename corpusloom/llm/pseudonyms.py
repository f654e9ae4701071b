"""PII pseudonyms: format-preserving Feistel permutations as Spark SQL expressions; no Python on the executors.

A match becomes a vector of (value, radix) components, e.g. one per digit. Eight Feistel rounds add to one half a keyed
function of the other half, each component modulo its radix, so every format maps onto itself one to one: equal values
get equal pseudonyms everywhere, different values different ones, and a pseudonym is again a valid value.

Formats, each validated: payment cards (13 to 19 digits with Luhn's check digit, which is recomputed; the first digit
stays), North American phone numbers, US social security numbers, IPv4 addresses, ISO dates (permuted within their
century, so month lengths and leap years hold) and the local part of e-mail addresses (case and kind of each character
stay). Numbers that fail validation, such as version numbers, are left alone."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which they are tried at a place; each pattern fits one kind's whole match.
#: Digits, spaces and hyphens, in which cards and other numbers may stand side by side; `_run` looks inside.
RUN = r"[0-9][0-9 -]{11,}(?<=[0-9])"
PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
DATE = r"(?:1[6-9]|2[0-3])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
#: Only classes of characters are repeated, never groups, so that a domain of any length needs no stack.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
#: Where a candidate may begin and end: not inside a longer number or word.
ANY = rf"(?<![A-Za-z0-9._%+@-])(?:{EMAIL})|(?<![0-9A-Za-z.+-])(?:(?:{DATE}|{SSN}|{PHONE}|{IPV4}|{RUN})(?![0-9A-Za-z]|[.-][0-9]))"
ROUNDS = 8
#: Days of a century that holds no 400th year, and of one that does: a product of two radices each.
CENTURY, LEAP_CENTURY = (92, 397), (75, 487)
#: Longer vectors are permuted in pieces of so many components, and longer tweaks are told by their digest: work stays linear.
PIECE, LONGEST_TWEAK = 64, 255


def _digest(key: str, tweak: Column, *parts: Column) -> Column:
    """A keyed 48-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, *parts), 256), 1, 12), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once and stands in the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radices: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """Permute vectors of longs with these radices, as chosen by key and tweak. One component alone is rotated by a keyed amount."""

    def permute(v: Column) -> Column:
        x = v["x"]
        half = F.floor(F.size(x) / 2).cast("int")

        def step(state: Column, r: Column) -> Column:
            other = F.concat_ws(",", F.transform(F.filter(state, lambda _, i: (i < half) != (r % 2 == 0)), lambda y: y.cast("string")))
            move = lambda o: F.transform(state, lambda y, i: F.when((i < half) == (r % 2 == 0), (y + _digest(key, v["t"], r.cast("string"), i.cast("string"), o)) % F.get(v["m"], i)).otherwise(y))
            return let(other, move)

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)

    return let(F.struct(values.alias("x"), radices.alias("m"), tweak.alias("t")), permute)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _number(s: Column) -> Column:
    return s.cast("long")


def _spell(digits: Column, like: Column) -> Column:
    """`like` with its digits replaced, one after the other, by these."""
    at = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i + 1), "[^0-9]", ""))
    return let(digits, lambda ds: F.array_join(F.transform(_chars(like), lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(ds, at(i)).cast("string")).otherwise(c)), ""))


def _luhn(digits: Column) -> Column:
    """Luhn's sum of an array of digits; the last one is the check digit, the reversed places 1, 3, ... are doubled."""
    worth = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.pmod(2 * d, F.lit(10)) + F.floor(d / 5)))
    return F.aggregate(worth, F.lit(0).cast("long"), lambda s, x: s + x)


def _digits(m: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(m, "[^0-9]", "")), _number)


def _longs(*numbers: int) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in numbers])


def _card(m: Column, key: str) -> Column:
    def moved(d: Column) -> Column:
        n = F.size(d)
        body = F.slice(d, F.lit(2), n - 2)
        new = feistel(body, F.transform(body, lambda _: F.lit(10).cast("long")), key, F.concat(F.lit("card"), n.cast("string"), F.element_at(d, 1).cast("string")))
        whole = let(F.concat(F.slice(d, 1, 1), new), lambda bare: F.concat(bare, F.array(F.pmod(-_luhn(F.concat(bare, _longs(0))), F.lit(10)))))
        return _spell(whole, m)

    return let(_digits(m), moved)


def _run(m: Column, key: str) -> Column:
    """The leftmost numbers of a run that don't overlap: dates, SSNs and phones after a space, the longest valid cards at
    the beginning of any group of digits. What lies between them stays."""
    whole = lambda x, p: x.rlike(rf"^(?:{p})$")
    valid = lambda c: (c != "") & (_luhn(_digits(c)) % 10 == 0)
    groups = lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    one = lambda f: F.when(whole(f, DATE), _date(f, key)).when(whole(f, SSN), _ssn(f, key)).when(whole(f, PHONE), _phone(f, key)).otherwise(_card(f, key))

    def inside(v: Column) -> Column:
        """v: the run's parts, groups of digits in turn with what lies between them; a match is made of whole parts."""

        def found(i: Column) -> Column:
            rest = F.substring(F.array_join(F.transform(F.slice(v, 2 * i + 1, F.lit(40)), lambda t: F.substring(t, 1, 41)), ""), 1, 40)
            after = (i == 0) | F.get(v, 2 * i - 1).endswith(" ")
            other = F.when(after, F.regexp_extract(rest, rf"^(?:{DATE}|{SSN}|{PHONE})(?![0-9A-Za-z]|[.-][0-9])", 0)).otherwise("")
            cards = F.array(*[F.regexp_extract(rest, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1)])
            return let(other, lambda o: F.when(o != "", o).otherwise(F.coalesce(F.get(F.filter(cards, valid), F.lit(0)), F.lit(""))))

        every = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int")), found)

        def chosen(fs: Column) -> Column:
            """Of matches that overlap the left one holds. A letter for each group tells how many groups its match has, a for none;
            a pattern reads the letters from the left and skips those within a match."""
            letters = F.array_join(F.transform(fs, lambda f: F.char(F.lit(97) + F.size(groups(f)))), "")
            steps = F.regexp_extract_all(letters, F.lit("a|" + "|".join(f"{chr(97 + n)}.{{{n - 1}}}" for n in range(1, 20))), F.lit(0))
            kept = F.split(F.array_join(F.transform(steps, lambda s: F.rpad(F.substring(s, 1, 1), F.length(s), "-")), ""), "")
            part = lambda at: F.coalesce(F.get(v, at), F.lit(""))

            def told(flags: Column) -> Column:
                spell = lambda f, i: F.when(F.get(flags, i) == "-", "").when(f == "", F.concat(part(2 * i), part(2 * i + 1))).otherwise(F.concat(one(f), part(2 * (i + F.size(groups(f))) - 1)))
                return F.array_join(F.transform(fs, spell), "")

            return let(kept, told)

        return let(every, chosen)

    return let(F.regexp_extract_all(m, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), inside)


def _phone(m: Column, key: str) -> Column:
    """Area and exchange codes that begin with 2 to 9, as assigned ones do, keep that; others keep to 0 and 1."""

    def moved(d: Column) -> Column:
        extra = F.size(d) - 10  # a leading country code 1
        return let(F.slice(d, extra + 1, F.lit(10)), lambda ten: _spell(F.concat(F.slice(d, F.lit(1), extra), spun(ten)), m))

    def spun(ten: Column) -> Column:
        first = lambda i: (i == 0) | (i == 3)
        low = F.transform(ten, lambda x, i: F.when(first(i) & (x >= 2), 2).otherwise(0).cast("long"))
        radix = F.transform(ten, lambda x, i: F.when(~first(i), 10).when(x >= 2, 8).otherwise(2).cast("long"))
        return F.zip_with(feistel(F.zip_with(ten, low, lambda a, b: a - b), radix, key, F.lit("phone")), low, lambda a, b: a + b)

    return let(_digits(m), moved)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    new = feistel(F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1), _longs(898, 99, 9999), key, F.lit("ssn"))

    def spell(v: Column) -> Column:
        a = F.element_at(v, 1) + 1
        return F.format_string("%03d-%02d-%04d", a + F.when(a >= 666, 1).otherwise(0), F.element_at(v, 2) + 1, F.element_at(v, 3) + 1)

    return let(new, spell)


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), _number)
    return F.concat_ws(".", F.transform(feistel(parts, _longs(256, 256, 256, 256), key, F.lit("ipv4")), lambda v: v.cast("string")))


def _date(m: Column, key: str) -> Column:
    day = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    century = F.substring(m, 1, 2)

    def moved(v: Column) -> Column:
        new = feistel(F.array(F.floor(v["at"] / v["b"]), v["at"] % v["b"]), F.array(v["a"], v["b"]), key, F.concat(F.lit("date"), century))
        day = let(new, lambda x: F.date_add(v["start"], (F.element_at(x, 1) * v["b"] + F.element_at(x, 2)).cast("int")))
        return F.when(v["at"].isNull(), m).otherwise(F.date_format(day, "yyyy-MM-dd"))

    start, leap = F.concat(century, F.lit("00-01-01")).cast("date"), century.cast("int") % 4 == 0
    pick = lambda i: F.when(leap, LEAP_CENTURY[i]).otherwise(CENTURY[i]).cast("long")
    return let(F.struct(F.datediff(day, start).cast("long").alias("at"), start.alias("start"), pick(0).alias("a"), pick(1).alias("b")), moved)


_UPPER, _LOWER, _NUMBERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    chars = _chars(local)
    kind = lambda c: F.when(c.rlike("[0-9]"), _NUMBERS).when(c.rlike("[a-z]"), _LOWER).when(c.rlike("[A-Z]"), _UPPER)
    values = F.transform(chars, _place)
    radices = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long"))
    tweak = F.concat(F.lit("mail"), F.when(F.length(domain) > LONGEST_TWEAK, F.sha2(F.lower(domain), 256)).otherwise(F.lower(domain)))

    def pieces(v: Column) -> Column:
        at = lambda c, k: F.slice(c, k * PIECE + 1, F.lit(PIECE))
        one = lambda k: feistel(at(v["x"], k), at(v["m"], k), key, F.when(k == 0, v["t"]).otherwise(F.concat(v["t"], F.lit("|"), k.cast("string"))))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(v["x"]) - 1) / PIECE).cast("int")), one))

    new = let(F.struct(values.alias("x"), radices.alias("m"), tweak.alias("t")), pieces)
    spell = lambda v: F.array_join(F.transform(chars, lambda c, i: F.when(kind(c).isNull(), c).otherwise(F.substring(kind(c), F.get(v, i).cast("int") + 1, F.lit(1)))), "")
    return F.concat(let(new, spell), F.lit("@"), domain)


def _place(c: Column) -> Column:
    """0-based place of a letter or digit among its kind; 0 for other characters."""
    code = F.ascii(c)
    return F.when(c.rlike("[0-9]"), code - 48).when(c.rlike("[a-z]"), code - 97).when(c.rlike("[A-Z]"), code - 65).otherwise(0).cast("long")


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY."""
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return F.when(F.instr(m, "@") > 0, _email(m, key)).when(whole(DATE), _date(m, key)).when(whole(SSN), _ssn(m, key)).when(whole(PHONE), _phone(m, key)).when(whole(IPV4), _ipv4(m, key)).otherwise(_run(m, key))


#: Session setting that holds the secret key. Without it a key that anyone can read here is used, with a warning.
KEY_SETTING, OPEN_KEY = "spark.corpusloom.pseudonyms.key", "corpus-key"


def session_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms can be inverted by whoever has this source", stacklevel=3)
    return key or OPEN_KEY


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, into: str | None = None, n_chars: str | None = None) -> DataFrame:
    """Replace personal numbers, dates and addresses in `text` (or write the new text to `into`).

    Null texts stay null and empty ones empty; texts without a match are returned as they are; repeated rows get equal
    results; other columns, of whatever name, pass through. `n_chars`: a column to update to the new length (formats keep
    their length, but an IPv4 address may not). An empty table gives an empty one. The key is the parameter, else the
    session's KEY_SETTING."""
    key = session_key(docs.sparkSession) if key is None else key
    col = F.col(f"`{text}`")
    found = F.regexp_extract_all(col, F.lit(ANY), F.lit(0))
    between = F.split(col, ANY, -1)
    new = F.transform(found, lambda m: pseudonym(m, key))
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    out = docs.withColumn(into or text, F.when(col.rlike(ANY), joined).otherwise(col))
    return out.withColumn(n_chars, F.length(F.col(f"`{into or text}`")).cast("long")) if n_chars else out
