"""Business-rule scores of field values, one Column builder per rule, and the dispatch by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright import vocabulary as v
from formwright.functions.arrays import let
from formwright.functions.text import digits, strip

Validator = Callable[[Column], Column]


def _score(value: float) -> Column:
    return F.lit(float(value))


def _ssn_of(d: Column) -> Column:
    return (
        F.when(F.length(d) != 9, _score(0))
        .when(d.rlike("^(000|666|9)"), _score(0))
        .when((F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000"), _score(0))
        .when(d.rlike("012|123|234|345|456|567|678|789"), _score(0.2))
        .when(d.rlike(r"(\d{2,4})\1"), _score(0.3))
        .otherwise(_score(0.9))
    )


def ssn_score(value: Column) -> Column:
    return let(digits(value), _ssn_of)


def _ein_of(d: Column) -> Column:
    return (
        F.when(F.length(d) != 9, _score(0)).when(d.rlike("^(0|99)"), _score(0.3)).otherwise(_score(0.8))
    )


def ein_score(value: Column) -> Column:
    """Prefixes 10 to 98 are valid."""
    return let(digits(value), _ein_of)


_DIGITS = r"^\d+\.?\d*$"  # what most amounts are; the general form is tried after it
_USUAL = r"^\$?\d(,?\d){0,6}(\.\d{0,2})?\z"  # below ten million with two decimals at most, known by its form
_PLAIN_NUMBER = r"^\s*[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*$"
_WORD_NUMBER = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def amount_score(value: Column) -> Column:
    """`$`, `,` and one leading `-` are dropped before the number is read."""
    plain = let(F.translate(value, "$,", ""), _unsigned)
    other = let(plain, lambda text: let(_number_of(text), lambda n: _amount_of(text, n)))
    return F.when(value.rlike(_USUAL), _score(0.9)).otherwise(other)


def _unsigned(bare: Column) -> Column:
    return F.when(bare.startswith("-"), F.substr(bare, F.lit(2))).otherwise(bare)


def _number_of(text: Column) -> Column:
    return F.when(text.rlike(_DIGITS), text.try_cast("double")).when(
        text.rlike(_PLAIN_NUMBER) | text.rlike(_WORD_NUMBER),
        strip(F.translate(text, "_", "")).try_cast("double"),
    )


def _amount_of(text: Column, n: Column) -> Column:
    decimals = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1)))
    return (
        F.when(n.isNull(), _score(0.1))
        .when(~F.isnan(n) & (n < 0), _score(0.3))
        .when(~F.isnan(n) & (n > 10_000_000), _score(0.2))
        .when(decimals > 2, _score(0.4))
        .otherwise(_score(0.9))
    )


_DAY = r"(3[01]|[12]\d|0[1-9]| ?[1-9])"
_MONTH = r"(1[0-2]|0?[1-9])"
_YEAR = r"((?!0000)\d{4}|\d{2})"
_NAMES = "|".join(v.MONTHS) + "|" + "|".join(m[:3] for m in v.MONTHS)
_MONTH_FIRST = rf"^{_MONTH}([/-]){_DAY}\2{_YEAR}$"
_YEAR_FIRST = rf"^{_YEAR}-{_MONTH}-{_DAY}$"
_NAME_FIRST = rf"(?i)^({_NAMES})\s+{_DAY},\s+((?!0000)\d{{4}})$"
_DAY_FIRST = rf"(?i)^{_DAY}\s+({_NAMES})\s+((?!0000)\d{{4}})$"


def parsed_date(value: Column) -> Column:
    """Date in one of the accepted formats, else NULL.

    Formats: month/day/year and month-day-year, year-month-day (four- or two-digit year),
    `Month day, year` and `day Month year` with full or three-letter month names. Two-digit years
    from 69 on are in the 1900s. A text that fits two formats, as `01-02-03`, is read by the first of them.
    """

    def full_year(y: Column) -> Column:
        century = F.when(y >= "69", F.lit("19")).otherwise(F.lit("20"))
        return F.when(F.length(y) == 2, F.concat(century, y)).otherwise(y)

    def month_number(name: Column) -> Column:
        pairs = [x for i, m in enumerate(v.MONTHS, 1) for x in (F.lit(m[:3].lower()), F.lit(str(i)))]
        return F.try_element_at(F.create_map(*pairs), F.lower(F.substring(name, 1, 3)))

    def parsed(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        y, m, d = (F.regexp_extract(value, pattern, g) for g in (year, month, day))
        text = F.concat_ws("-", full_year(y), month_number(m) if named else m, F.trim(d))
        return F.when(value.rlike(pattern), text.try_cast("date"))

    return F.coalesce(
        parsed(_MONTH_FIRST, year=4, month=1, day=3),
        parsed(_YEAR_FIRST, year=1, month=2, day=3),
        parsed(_NAME_FIRST, year=3, month=1, day=2, named=True),
        parsed(_DAY_FIRST, year=3, month=2, day=1, named=True),
    )


def date_score(value: Column, as_of: Column | None = None) -> Column:
    """`as_of` stands for today, so that results can be reproduced."""
    return let(parsed_date(value), lambda d: _date_of(d, as_of))


def _date_of(d: Column, as_of: Column | None) -> Column:
    today = F.current_date() if as_of is None else as_of
    return (
        F.when(d.isNull(), _score(0))
        .when((F.year(d) < 1900) | (F.year(d) > F.year(today) + 1), _score(0.2))
        .when(d > today, _score(0.6))
        .otherwise(_score(0.9))
    )


def phone_score(value: Column) -> Column:
    return let(digits(value), _phone_of)


def _phone_of(d: Column) -> Column:
    return (
        F.when(F.length(d) == 10, _score(0.9))
        .when((F.length(d) == 11) & d.startswith("1"), _score(0.8))
        .otherwise(_score(0.2))
    )


def email_score(value: Column) -> Column:
    return F.when(value.rlike(v.EMAIL_PATTERN), _score(0.9)).otherwise(_score(0.1))


def account_score(value: Column) -> Column:
    return F.when(F.length(digits(value)).between(8, 17), _score(0.8)).otherwise(_score(0.3))


def routing_checksum_ok(nine_digits: Column) -> Column:
    """Weights 3, 7, 1 over the nine digits add up to a multiple of ten."""
    digit = [F.ascii(F.substring(nine_digits, i, 1)) - F.ascii(F.lit("0")) for i in range(1, 10)]
    weighted = sum((d * w for d, w in zip(digit, (3, 7, 1) * 3)), F.lit(0))
    return weighted % 10 == 0


def routing_score(value: Column) -> Column:
    return let(digits(value), _routing_of)


def _routing_of(d: Column) -> Column:
    return (
        F.when(F.length(d) != 9, _score(0.1))
        .when(routing_checksum_ok(d), _score(0.9))
        .otherwise(_score(0.6))
    )


def name_score(value: Column) -> Column:
    """Of the characters a name may have, `. , ' -` may make up 30 % at most."""
    special = F.length(F.regexp_replace(value, r"[^.,'-]", ""))
    return (
        F.when(F.length(value) < 2, _score(0.1))
        .when(~value.rlike("(?U)" + v.NAME_PATTERN), _score(0.2))
        .when(special > F.length(value) * F.lit(0.3), _score(0.3))
        .otherwise(_score(0.8))
    )


def address_score(value: Column) -> Column:
    return (
        F.when(F.length(value) < 10, _score(0.2))
        .when(value.rlike(r"\d"), _score(0.7))
        .otherwise(_score(0.3))
    )


def default_validators(as_of: Column | None = None) -> dict[str, Validator]:
    """Rule per field name; a copy may be changed or extended and passed to the engine."""
    rules: dict[str, Validator] = {name: amount_score for name in v.AMOUNT_FIELDS}
    rules.update(
        SSN=ssn_score,
        EMPLOYER_EIN=ein_score,
        DATE=lambda value: date_score(value, as_of),
        PHONE_NUMBER=phone_score,
        EMAIL=email_score,
        ACCOUNT_NUMBER=account_score,
        ROUTING_NUMBER=routing_score,
        EMPLOYER_NAME=name_score,
        EMPLOYEE_NAME=name_score,
        ADDRESS=address_score,
    )
    return rules


_STRIPPED = r"^[!-~](.*[!-~])?\z"  # no white space at either end, as most values are; cheaper to see than to strip


def field_score(
    field_name: Column, value: Column, validators: Mapping[str, Validator] | None = None
) -> Column:
    """Score of a value under the rule of its field.

    Blank or missing values score 0; fields without a rule score 0.5, and so do values for which a
    rule gives NULL. Only the branch of the row's field is evaluated.
    """
    rules = default_validators() if validators is None else validators
    names_of: dict[Validator, list[str]] = {}
    for name, rule in rules.items():
        names_of.setdefault(rule, []).append(name)

    def dispatch(text: Column) -> Column:
        score = F.when(F.coalesce(text, F.lit("")) == "", _score(0))
        for rule, names in names_of.items():
            score = score.when(field_name.isin(names), rule(text))
        return F.coalesce(score, _score(0.5))

    return let(F.when(value.rlike(_STRIPPED), value).otherwise(strip(value)), dispatch)


def with_field_score(
    rows: DataFrame, field_name: str, value: str, score: str = "score", as_of: Column | None = None
) -> DataFrame:
    """Adds the score of each row's value under the default rule of its field.

    The same scores as `field_score`, for rows: what a rule looks at several times is a column of its own
    and not a variable inside an expression, so all of it is compiled.
    """
    names = [f"_{score}_{part}" for part in ("text", "digits", "bare", "plain", "number", "date")]
    text, number_digits, bare, plain, number, date = names
    name = F.col(field_name)
    by_digits = {
        "SSN": _ssn_of, "EMPLOYER_EIN": _ein_of, "PHONE_NUMBER": _phone_of, "ROUTING_NUMBER": _routing_of,
    }
    stripped = rows.withColumn(text, strip(F.col(value)))
    amounts = name.isin(*v.AMOUNT_FIELDS)
    parts = stripped.withColumns(
        {
            number_digits: F.when(name.isin(*by_digits), digits(F.col(text))),
            bare: F.when(amounts, F.translate(F.col(text), "$,", "")),
            date: F.when(name == "DATE", parsed_date(F.col(text))),
        }
    )
    parts = parts.withColumn(plain, _unsigned(F.col(bare)))
    parts = parts.withColumn(number, _number_of(F.col(plain)))
    found = F.when(F.coalesce(F.col(text), F.lit("")) == "", _score(0))
    found = found.when(amounts, _amount_of(F.col(plain), F.col(number)))
    for field, rule in by_digits.items():
        found = found.when(name == field, rule(F.col(number_digits)))
    found = (
        found.when(name == "DATE", _date_of(F.col(date), as_of))
        .when(name == "EMAIL", email_score(F.col(text)))
        .when(name == "ACCOUNT_NUMBER", account_score(F.col(text)))
        .when(name.isin("EMPLOYER_NAME", "EMPLOYEE_NAME"), name_score(F.col(text)))
        .when(name == "ADDRESS", address_score(F.col(text)))
    )
    return parts.withColumn(score, F.coalesce(found, _score(0.5))).drop(*names)
