"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) stay whatever their score. The method adds: ``iban`` (mod-97 confirms; unbroken, or as printed: any case,
one space or hyphen between characters, with the length of its country), ``ssn`` and ``local_phone`` (no checksum, so words nearby must lift them over the threshold). DataFrame functions only.

Edge cases: a null text counts as empty; repeated rows give repeated results; an empty table an empty result; only the
named columns are read. Possessive patterns keep very long runs of digits or letters linear and off the regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

#: The kinds in order, their patterns, and words that make a kind likelier.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])"
#: Letters and digits of an account number by country, from the register of such numbers; the printed form needs it to know where one ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REST = {n: rf"[\x20-]?[0-9][\x20-]?[0-9](?:[\x20-]?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n in IBAN_LENGTHS}
_LAND = {n: f"(?i:{'|'.join(lands.split())})" for n, lands in IBAN_LENGTHS.items()}
#: Printed form: any case, one space or hyphen between characters. The first takes the country alone, so that no start is hidden by a span
#: before it; two letters before a figure are looked for first, as hardly a word has them.
IBAN_START = r"(?<![A-Za-z0-9])(?=[A-Za-z]{2}[\x20-]?[0-9])(?:" + "|".join(f"{_LAND[n]}(?={_REST[n]})" for n in IBAN_LENGTHS) + ")"
IBAN_WHOLE = "^(?:" + "|".join(_LAND[n] + _REST[n] for n in IBAN_LENGTHS) + ")"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
CONTEXT = {
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|tax|taxpayer)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b",
}
#: Score of a pattern alone, of a checksum that holds, and of a context word within WINDOW characters; a span needs THRESHOLD.
PATTERN_SCORE, CHECKSUM_SCORE, CONTEXT_SCORE, THRESHOLD, WINDOW = 0.4, 0.4, 0.35, 0.7, 40


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    figure = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(figure, F.lit(0), lambda acc, x: acc + F.when(x["i"] % 2 == 1, doubled(x["d"])).otherwise(x["d"]))
    return total % 10 == 0


def compact(value: Column) -> Column:
    """An account number without separators, in upper case."""
    return F.upper(F.regexp_replace(value, r"[\x20-]", ""))


def mod97(value: Column) -> Column:
    """Whether a bank account number's remainder is 1 once its first four characters go last and letters count 10 to 35."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    number = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    codes = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), number)
    rest = F.aggregate(codes, F.lit(0), lambda acc, k: (acc * F.when(k > 9, 100).otherwise(10) + k) % 97)
    return rest == 1


def printed_ibans(text: Column, kind_no: int) -> Column:
    """Spans of account numbers as printed whose checksum holds; a country's own length says where each ends."""

    def whole(s: Column) -> Column:
        value = F.regexp_extract(F.substring(text, (s["at"] + 1).cast("int"), F.lit(80)), IBAN_WHOLE, 0)
        return F.struct(s["at"].alias("at"), s["kind_no"].alias("kind_no"), (s["at"] + F.length(value)).alias("until"), s["kind"].alias("kind"), value.alias("value"))

    return F.filter(F.transform(S.find(text, "iban", kind_no, IBAN_START), whole), lambda s: mod97(compact(s["value"])))


def small_parts(value: Column) -> Column:
    """Whether each dotted part is at most 255, leading zeros ignored."""
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def context_score(text: Column, span: Column, kind: str) -> Column:
    begin = F.greatest(span["at"] - WINDOW, F.lit(0))
    near = F.substring(text, (begin + 1).cast("int"), (span["until"] + WINDOW - begin).cast("int"))
    return F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and ``spans``: an array of (at, kind_no, until, kind, value) by kind, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_digits = lambda s: F.length(digits(s["value"]))
    base = documents.select(
        "doc_id",
        text.alias("text"),
        F.concat(
            S.find(text, "email", 0, EMAIL, "@"),
            F.filter(S.find(text, "ip", 1, IP), lambda s: small_parts(s["value"])),
            F.filter(S.find(text, "card", 2, CARD), lambda s: luhn(digits(s["value"]))),
            F.filter(S.find(text, "phone", 3, PHONE, "+"), lambda s: n_digits(s).between(9, 15)),
        ).alias("base"),
        printed_ibans(text, KINDS.index("iban")).alias("printed"),
    )
    text = F.col("text")

    def ibans() -> Column:
        """Printed forms, and unbroken runs of any country that are none of these."""
        no = KINDS.index("iban")
        joined = F.filter(S.find(text, "iban", no, IBAN), lambda s: ~F.exists("printed", lambda p: (p["at"] == s["at"]) & (p["until"] == s["until"])))
        return F.concat(F.col("printed"), joined)

    def more(kind: str, found: Column, confirm) -> Column:
        score = lambda s: F.lit(PATTERN_SCORE) + confirm(s["value"]) + context_score(text, s, kind)
        # What a checksum confirms also stands where a base span lies.
        return F.filter(found, lambda s: (score(s) >= THRESHOLD) & (F.lit(kind == "iban") | ~S.overlaps(s, F.col("base"))))

    no_checksum = lambda _: F.lit(0.0)
    added = F.concat(
        more("iban", ibans(), lambda v: F.when(mod97(compact(v)), F.lit(CHECKSUM_SCORE)).otherwise(F.lit(-1.0))),
        more("ssn", S.find(text, "ssn", KINDS.index("ssn"), SSN), no_checksum),
        more("local_phone", S.find(text, "local_phone", KINDS.index("local_phone"), LOCAL_PHONE), no_checksum),
    )
    by_kind = lambda a, b: (
        F.when(a["kind_no"] < b["kind_no"], -1).when(a["kind_no"] > b["kind_no"], 1).when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    )
    return base.select("doc_id", F.array_sort(F.concat("base", added), by_kind).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``, and n_pii, the number of all spans."""
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return scanned.select(
        "doc_id",
        *(S.count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS),
        F.size("spans").cast("bigint").alias("n_pii"),
        F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
