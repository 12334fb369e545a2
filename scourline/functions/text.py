"""Pure Column expressions: text shape, lenient numbers and dates, rounding. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a phone, an e-mail, a currency sign, a special character.
PHONE = r"[\d\s\-\(\)\.]{10,}"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CURRENCY = "[$€£¥]"
SPECIAL = r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]"
#: A number as the lenient casts read it.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy")


def strip(c: Column) -> Column:
    """Without white space, tabs and line ends on both sides."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, with single spaces inside."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def title(c: Column) -> Column:
    """Each word between white space with a capital first letter and the rest in lower case."""
    return F.initcap(F.regexp_replace(c, r"\s", " "))


def round_half_up(c: Column, places: int = 2) -> Column:
    """Half away from zero, by the same arithmetic as in plain SQL: sign(x) * floor(abs(x) * 10^n + 0.5) / 10^n."""
    scale = float(10**places)
    c = c.cast("double")
    # Beyond 2^53 a double has no fraction to round.
    return F.when(F.abs(c) * scale < 9.0e15, F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale).otherwise(c)


def number(c: Column) -> Column:
    """Text as a double; null where it is not a plain decimal number."""
    trimmed = strip(c.cast("string"))
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def currency_number(c: Column) -> Column:
    return number(F.regexp_replace(c, "[$,€£¥]", ""))


def date_of(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that reads the text wins; null if none does."""
    trimmed = strip(c)
    return F.coalesce(*[F.try_to_date(trimmed, f) for f in formats])


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def is_title(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{L}\p{Lu}") & ~c.rlike(r"(^|[^\p{L}])\p{Ll}")


def has_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}")


def has_lower(c: Column) -> Column:
    return c.rlike(r"\p{Ll}")


def is_phone(c: Column) -> Column:
    """Looks like a phone and has ten digits at least, which keeps ISO dates out."""
    return c.rlike(PHONE) & (F.length(F.regexp_replace(c, r"[^0-9]", "")) >= 10)


def phone_like(c: Column) -> Column:
    return c.rlike(PHONE)


def email_like(c: Column) -> Column:
    return c.rlike(EMAIL)


def digit_share(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, "[^0-9]", "")) / n).otherwise(0.0)


def one_character(c: Column) -> Column:
    """A non-empty text that repeats a single character."""
    return (c != "") & (F.replace(c, F.substring(c, 1, 1), F.lit("")) == "")


#: Case classes in the order in which the first that holds counts.
CASES = (("title_case", is_title), ("upper_case", is_upper), ("lower_case", is_lower), ("mixed_case", lambda c: has_upper(c) & has_lower(c)))


def case_class(c: Column) -> Column:
    out = F.when(CASES[0][1](c), CASES[0][0])
    for name, test in CASES[1:]:
        out = out.when(test(c), name)
    return out.otherwise("other")


def token(kind: T.DataType) -> str:
    """The name by which rules know a Spark type; rules match by substring, so ``double`` must read ``float64``."""
    names = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime"}
    if isinstance(kind, T.DecimalType):
        return "float64"
    return names.get(type(kind), kind.simpleString())


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_boolean(kind: T.DataType) -> bool:
    return isinstance(kind, T.BooleanType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
