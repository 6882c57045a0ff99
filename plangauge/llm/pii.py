"""Format-preserving pseudonyms for personal data, by a keyed Feistel network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.core.columns import others

ROUNDS = 10
#: Days of 400 Gregorian years, 146,097 = 189 x 773; a date's pseudonym lies in the same such span, counted from the year 0.
DATE_HALVES = (189, 773)
DATE_START = "0000-01-01"
#: Social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
AREAS, REST = 898, 99 * 9999
#: Steps of a walk that ends, at each step, with a chance of 0.6.
WALK = 64

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
#: A telephone number with a digit from 1 to 9 among its last ten.
NOT_ZEROS = r"[1-9](?:[^0-9]*[0-9]){0,9}$"
#: All but e-mail and cards begin with a digit, + or (; looking for that first passes over other text quickly.
NUMBERS = f"(?=[0-9+(])(?:{'|'.join((IPV4, DATE, SSN, PHONE))})"
#: How cards are written, the likelier first; then any 13 to 19 digits in any groups, the longest first.
LAYOUTS = ["[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4}", "[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", "[0-9]{13,19}"]
GROUPED = [f"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]
#: Every card holds this; a border is where a group of digits begins or ends, letters being part of a group.
LONG, BORDER = "[0-9](?:[ -]?[0-9]){12}", "(?<![0-9A-Za-z])(?=[0-9])|(?<=[0-9])(?![0-9A-Za-z])"
#: Every number of any kind holds this; most texts do not.
HINT = r"[0-9][0-9 ()./-]{5,}[0-9]"


def let(value: Column, body) -> Column:
    """body(value), the value worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """Struct (a, b): the keyed permutation of pairs left < left_size, right < right_size. Bijective for any sizes; ROUNDS is even."""
    def step(acc: Column, i: Column) -> Column:
        mac = F.sha2(F.concat_ws("|", F.lit(key), tweak, left_size, right_size, i, acc["b"]), 256)
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        return F.struct(acc["b"].alias("a"), let(size, lambda n: F.pmod(acc["a"] + F.pmod(F.conv(F.substring(mac, 1, 15), 16, 10).cast("long"), n), n)).alias("b"))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of 2 to 36 digits as another one of the same length."""
    size = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")

    def halves(x: Column) -> Column:
        u, v = x["u"], x["v"]
        out = feistel(x["d"].substr(F.lit(1), u), x["d"].substr(u + 1, v), x["m"], x["n"], key, tweak)
        return let(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), u, "0"), F.lpad(o["b"].cast("string"), v, "0")))

    split = let(digits, lambda d: F.struct(d.alias("d"), F.floor(F.length(d) / 2).cast("int").alias("u"), (F.length(d) - F.floor(F.length(d) / 2)).cast("int").alias("v")))
    sized = let(split, lambda x: F.struct(x["d"].alias("d"), x["u"].alias("u"), x["v"].alias("v"), size(x["u"]).alias("m"), size(x["v"]).alias("n")))
    return let(sized, halves)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string, its last digit being the check digit."""
    def total(d: Column) -> Column:
        n = F.length(d)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
        return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))

    return let(digits, total)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits, in order, replaced by `digits`."""
    acc = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def filled(d: Column) -> Column:
        step = lambda a, c: F.when((c >= "0") & (c <= "9"), F.struct(F.concat(a["s"], F.substring(d, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
        return F.aggregate(F.split(m, ""), acc, step, lambda a: a["s"])

    return let(digits, filled)


def _card(m: Column, key: str) -> Column:
    body = let(_only_digits(m), lambda d: permuted_digits(d.substr(F.lit(1), F.length(d) - 1), key, F.lit("card")))
    whole = let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
    return _refilled(m, whole)


def _number(m: Column, key: str, kind: str) -> Column:
    return _refilled(m, permuted_digits(_only_digits(m), key, F.lit(kind)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the ten digits of the number are permuted, so one number is one pseudonym however it is written."""
    parts = let(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0), lambda c: F.struct(c.alias("code"), m.substr(F.length(c) + 1, F.length(m)).alias("rest")))
    return let(parts, lambda x: F.concat(x["code"], _number(x["rest"], key, "phone")))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    half = F.lit(65536).cast("long")
    out = let(octets, lambda o: feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, key, F.lit("ipv4")))
    return let(out, lambda o: F.concat_ws(".", F.floor(o["a"] / 256), o["a"] % 256, F.floor(o["b"] / 256), o["b"] % 256))


def _date_of(m: Column) -> Column:
    return F.when(m.rlike("^[0-9]{4}-"), F.try_to_date(m, "yyyy-MM-dd")).when(m.substr(3, 1) == ".", F.try_to_date(m, "dd.MM.yyyy")).otherwise(F.coalesce(F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy")))


def _moved_date(d: Column, key: str, kind: str) -> Column:
    """Another date of the same 400 years."""
    a, b = DATE_HALVES

    def moved(day: Column) -> Column:
        out = let(F.pmod(day, F.lit(a * b)).cast("long"), lambda x: feistel(F.floor(x / b), x % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, F.lit(kind)))
        return let(out, lambda o: F.date_add(F.to_date(F.lit(DATE_START)), (day - F.pmod(day, F.lit(a * b)) + o["a"] * b + o["b"]).cast("int")))

    return let(F.datediff(d, F.to_date(F.lit(DATE_START))), moved)


def _date(m: Column, key: str) -> Column:
    """A date written as the first one is. One that can only be read day first stays so: it is moved again and again, by a permutation of its own, until its day is over 12."""
    month_first = F.try_to_date(m, "MM/dd/yyyy").isNotNull()
    plain = let(_date_of(m), lambda d: _moved_date(d, key, "date"))
    walk = let(_date_of(m), lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(d.alias("d"), F.lit(False).alias("done")), lambda x, _: F.when(x["done"], x).otherwise(let(_moved_date(x["d"], key, "day first"), lambda n: F.struct(n.alias("d"), (F.dayofmonth(n) > 12).alias("done"))))))
    return (
        F.when(m.rlike("^[0-9]{4}-"), F.date_format(plain, "yyyy-MM-dd")).when(m.substr(3, 1) == ".", F.date_format(plain, "dd.MM.yyyy")).when(month_first, F.date_format(plain, "MM/dd/yyyy"))
        .otherwise(F.date_format(walk["d"], "dd/MM/yyyy"))
    )


def _ssn(m: Column, key: str) -> Column:
    """Another valid number: area, group and serial are permuted together among the valid ones."""
    area, group, serial = m.substr(1, 3).cast("long"), m.substr(5, 2).cast("long"), m.substr(8, 4).cast("long")
    left = area - F.when(area > 666, 2).otherwise(1)
    out = feistel(left, (group - 1) * 9999 + serial - 1, F.lit(AREAS).cast("long"), F.lit(REST).cast("long"), key, F.lit("ssn"))
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return let(out, lambda o: F.concat_ws("-", padded(o["a"] + F.when(o["a"] >= 665, 2).otherwise(1), 3), padded(F.floor(o["b"] / 9999) + 1, 2), padded(o["b"] % 9999 + 1, 4)))


def _email(m: Column, key: str) -> Column:
    """Only the part before @ changes: letters and digits by keyed substitutes of their kind; equal addresses stay equal, case aside."""
    domain = F.substring_index(m, "@", -1)
    first = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    both = let(first, lambda x: F.struct(F.concat(x, F.sha2(F.concat(x, F.lit(key)), 256)).alias("mac"), F.substring_index(m, "@", 1).alias("local")))

    def one(x: Column, i: Column) -> Column:
        c, byte = F.substring(x["local"], i, F.lit(1)), F.conv(F.substring(x["mac"], F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(byte, F.lit(26)) + 1, F.lit(1))
        return F.when(c.rlike("[A-Za-z]"), letter).when(c.rlike("[0-9]"), F.pmod(byte, F.lit(10)).cast("string")).otherwise(c)

    local = let(both, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["local"])), lambda i: one(x, i)), ""))
    return F.concat(local, F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of EMAIL or NUMBERS.

    A match that is not valid for its kind stays as it is: an octet over 255 or with a leading zero, a date that does not exist, a
    social security number of an area, group or serial that is never given out, a telephone number of zeros alone.
    """
    full = lambda p: m.rlike(f"^(?:{p})$")
    octets = F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ~x.rlike("^0."))
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(full(IPV4), F.when(octets, _ipv4(m, key)).otherwise(m))
        .when(full(DATE), F.when(_date_of(m).isNotNull(), _date(m, key)).otherwise(m))
        .when(full(SSN), F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), _ssn(m, key)).otherwise(m))
        .when(full(PHONE), F.when(m.rlike(NOT_ZEROS), _phone(m, key)).otherwise(m))
    )


def _part(text: Column, done: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(done).alias("done"))


def _woven(text: Column, pattern: str, key: str) -> Column:
    """Parts (text, done) of a text: what lies between the matches of a pattern, and the pseudonym of each match, done."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda s, m: F.array(_part(s, False), _part(F.when(m.isNotNull(), pseudonym(m, key)), True)))
    return F.filter(F.flatten(pairs), lambda x: x["text"].isNotNull())


def _cards(text: Column, layouts: list[str], key: str) -> Column:
    """Parts (text, done) of a text: the pseudonyms of its cards, done, and what lies between them.

    A card is a run of atoms (groups of digits and what parts them) that has one of the layouts and passes Luhn's test. Each atom is marked
    with the number of atoms of the card that begins there (b for 1, c for 3 and so on; a for none); the cards are then taken from
    the left, without overlap, by one pattern over the marks. Linear in the text.
    """
    def mark(s: Column) -> Column:
        valid = F.filter(F.array(*[F.regexp_extract(s, f"^(?:{p})(?![0-9A-Za-z])", 0) for p in layouts]), lambda c: F.when(c != "", F.pmod(luhn_sum(_only_digits(c)), F.lit(10)) == 0).otherwise(F.lit(False)))
        return let(F.try_element_at(valid, F.lit(1)), lambda c: F.when(c.isNull(), "a").otherwise(F.char(F.length(F.regexp_replace(c, "[0-9]", "")) + 98)))

    def parts(atoms: Column) -> Column:
        marks = F.array_join(F.transform(atoms, lambda x, i: F.when(x.rlike("^[0-9]"), let(F.array_join(F.slice(atoms, i + 1, F.lit(37)), ""), mark)).otherwise(F.lit("a"))), "")
        taken = F.regexp_extract_all(marks, F.lit("(a++|" + "|".join(f"{chr(98 + n)}.{{{2 * n}}}" for n in range(19)) + ")"), F.lit(1))
        return let(taken, lambda t: let(starts(t), lambda at: F.zip_with(t, at, lambda m, k: one(m, F.array_join(F.slice(atoms, k, F.length(m)), "")))))

    def starts(taken: Column) -> Column:
        firsts = F.split(F.array_join(F.transform(taken, lambda m: F.concat(F.lit("^"), F.repeat(F.lit("-"), F.length(m) - 1))), ""), "")
        return F.filter(F.transform(firsts, lambda c, i: F.when(c == "^", i + 1)), lambda k: k.isNotNull())

    def one(m: Column, s: Column) -> Column:
        return F.when(m.startswith("a"), _part(s, False)).otherwise(_part(_card(s, key), True))

    return F.when(text.rlike(LONG), let(F.split(text, BORDER, -1), parts)).otherwise(F.array(_part(text, False)))


def _refined(parts: Column, cut) -> Column:
    """Parts with each that is not done cut further."""
    return F.flatten(F.transform(parts, lambda x: F.when(x["done"], F.array(x)).otherwise(cut(x["text"]))))


def pseudonymise(df: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """df with the personal data in text_col replaced by pseudonyms of the same format; with count_col, how many values a row had.

    Card numbers (Luhn), dates, IPv4 addresses, telephone and social security numbers are permuted by a Feistel network keyed by
    `key`, each within its own format: an equal value has an equal pseudonym in every document, and different values of a format
    have different ones. E-mail addresses get keyed substitutes before the @. Cards in a usual layout go first, then the other numbers, then
    any 13 to 19 digits between borders that pass Luhn's test, so that a card is found whatever digits stand beside it. One pass over
    the rows, no shuffle, whole texts; a null text stays null and has count 0, other columns and rows without personal data stay as
    they are. Repeated rows have equal results; an empty table gives an empty one. An input column named count_col is replaced; names
    that begin with _pg_ are reserved.
    """
    text = F.col(text_col)
    done = lambda c: F.size(F.filter(c, lambda x: x["done"]))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    out = df.withColumn("_pg_mails", F.when(F.contains(text, F.lit("@")), _woven(text, EMAIL, key)))
    out = out.withColumn("_pg_text", F.when(F.col("_pg_mails").isNotNull(), joined("_pg_mails")).otherwise(text))
    out = out.withColumn("_pg_cards", F.when(F.col("_pg_text").rlike(HINT), _cards(F.col("_pg_text"), LAYOUTS, key)))
    out = out.withColumn("_pg_numbers", _refined(F.col("_pg_cards"), lambda t: _woven(t, NUMBERS, key)))
    out = out.withColumn("_pg_parts", _refined(F.col("_pg_numbers"), lambda t: _cards(t, GROUPED, key)))
    out = out.withColumn("_pg_new", F.when(F.col("_pg_parts").isNotNull(), joined("_pg_parts")).otherwise(F.col("_pg_text")))
    if count_col:
        out = out.withColumn(count_col, (F.coalesce(F.when(F.col("_pg_mails").isNotNull(), done("_pg_mails")), F.lit(0)) + F.coalesce(F.when(F.col("_pg_parts").isNotNull(), done("_pg_parts")), F.lit(0))).cast("long"))
    plain = [F.col("_pg_new").alias(c) if c.lower() == text_col.lower() else F.col(q) for c, q in zip(df.columns, others(df), strict=True) if c.lower() != (count_col or "").lower()]
    return out.select(*plain, *([count_col] if count_col else []))
