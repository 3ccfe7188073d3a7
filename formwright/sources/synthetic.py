"""Synthetic labelled texts and token sequences, picked from the row's id so that runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.vocabulary import DOCUMENT_TYPES

# Example texts, three for each document type in class order.
EXAMPLE_TEXTS = (
    (
        "Wage and Tax Statement 2023 Employee's social security number 123-45-6789",
        "Form W-2 Wage and Tax Statement Employer identification number 12-3456789",
        "Wages, tips, other compensation $50,000.00 Federal income tax withheld $5,000.00",
    ),
    (
        "Form 1099-R Distributions From Pensions, Annuities, Retirement or Profit-Sharing Plans",
        "Gross distribution $25,000.00 Taxable amount $20,000.00",
        "Pension distribution 1099-R retirement plan distribution",
    ),
    (
        "Form 1099-MISC Miscellaneous Income Nonemployee compensation $15,000.00",
        "Rents $12,000.00 Royalties $3,000.00 Other income $2,000.00",
        "1099-MISC miscellaneous income contractor payments",
    ),
    (
        "Form 1099-DIV Dividends and Distributions Total ordinary dividends $1,500.00",
        "Qualified dividends $1,200.00 Capital gain distributions $300.00",
        "1099-DIV dividend income investment distributions",
    ),
    (
        "Receipt Date: 03/15/2023 Business expense $150.00 Office supplies",
        "Restaurant receipt $45.67 Business meal expense",
        "Travel expense receipt hotel accommodation $200.00",
    ),
    (
        "Bank Statement Account Number 1234567890 Statement Period 01/01/2023 - 01/31/2023",
        "Beginning Balance $5,000.00 Ending Balance $4,500.00",
        "Monthly bank statement checking account transactions",
    ),
    (
        "Form 1040 U.S. Individual Income Tax Return Tax year 2023",
        "Adjusted gross income $75,000.00 Taxable income $60,000.00",
        "1040 individual tax return federal income tax",
    ),
    (
        "Schedule A Itemized Deductions Medical and dental expenses $2,000.00",
        "State and local taxes $8,000.00 Mortgage interest $12,000.00",
        "Schedule A itemized deductions charitable contributions",
    ),
)

# Example token sequences with their tags. Some have more tags than tokens.
EXAMPLE_TOKENS = (
    (
        (
            "Employee", "Name", ":", "John", "Doe", "SSN", ":", "123-45-6789",
        ),
        (
            "O", "O", "O", "B-EMPLOYEE_NAME", "I-EMPLOYEE_NAME", "O", "O", "B-SSN", "I-SSN",
            "I-SSN",
        ),
    ),
    (
        (
            "Employer", ":", "ABC", "Corporation", "EIN", ":", "12-3456789",
        ),
        (
            "O", "O", "B-EMPLOYER_NAME", "I-EMPLOYER_NAME", "O", "O", "B-EMPLOYER_EIN",
            "I-EMPLOYER_EIN",
        ),
    ),
    (
        (
            "Wages", ":", "$", "50", ",", "000", ".", "00",
        ),
        (
            "O", "O", "O", "B-WAGE_AMOUNT", "I-WAGE_AMOUNT", "I-WAGE_AMOUNT", "I-WAGE_AMOUNT",
            "I-WAGE_AMOUNT",
        ),
    ),
    (
        (
            "Federal", "Tax", "Withheld", ":", "$", "5", ",", "000", ".", "00",
        ),
        (
            "O", "O", "O", "O", "O", "B-FEDERAL_TAX", "I-FEDERAL_TAX", "I-FEDERAL_TAX",
            "I-FEDERAL_TAX", "I-FEDERAL_TAX",
        ),
    ),
    (
        (
            "Date", ":", "12", "/", "31", "/", "2023",
        ),
        (
            "O", "O", "B-DATE", "I-DATE", "I-DATE", "I-DATE", "I-DATE",
        ),
    ),
    (
        (
            "Address", ":", "123", "Main", "St", ",", "Anytown", ",", "NY", "12345",
        ),
        (
            "O", "O", "B-ADDRESS", "I-ADDRESS", "I-ADDRESS", "I-ADDRESS", "I-ADDRESS", "I-ADDRESS",
            "I-ADDRESS", "I-ADDRESS",
        ),
    ),
    (
        (
            "Phone", ":", "555", "-", "123", "-", "4567",
        ),
        (
            "O", "O", "B-PHONE_NUMBER", "I-PHONE_NUMBER", "I-PHONE_NUMBER", "I-PHONE_NUMBER",
            "I-PHONE_NUMBER",
        ),
    ),
    (
        (
            "Email", ":", "john.doe", "@", "email.com",
        ),
        (
            "O", "O", "B-EMAIL", "I-EMAIL", "I-EMAIL",
        ),
    ),
)

TEXT_VARIATIONS = 7
TOKEN_VARIATIONS = 5


def _pick(choices: list[Column], index: Column) -> Column:
    return F.get(F.array(*choices), index.cast("int"))


def text_variation(text: Column, index: Column) -> Column:
    """As is, upper, lower, with a suffix, with a prefix, a year later, `USD` for `$`."""
    return _pick(
        [
            text,
            F.upper(text),
            F.lower(text),
            F.concat(text, F.lit(" Additional information here.")),
            F.concat(F.lit("Document: "), text),
            F.replace(text, F.lit("2023"), F.lit("2024")),
            F.replace(text, F.lit("$"), F.lit("USD ")),
        ],
        index,
    )


def synthetic_texts(ids: DataFrame, id_column: str) -> DataFrame:
    """(sample_id, label_id, text) for each id: class, example and variation by remainder."""
    key = F.col(id_column)
    label = F.pmod(key, F.lit(len(DOCUMENT_TYPES))).cast("int")
    examples = [F.array(*[F.lit(text) for text in texts]) for texts in EXAMPLE_TEXTS]
    base = F.get(_pick(examples, label), F.pmod(key, F.lit(3)).cast("int"))
    return ids.select(
        key.alias("sample_id"),
        label.alias("label_id"),
        text_variation(base, F.pmod(key, F.lit(TEXT_VARIATIONS))).alias("text"),
    )


def create_synthetic_texts(spark: SparkSession, num_samples: int = 1000) -> DataFrame:
    """The same number of samples for each class, `num_samples` in all if that can be divided."""
    n = len(DOCUMENT_TYPES)
    return synthetic_texts(spark.range(num_samples // n * n), "id")


def synthetic_sequences(ids: DataFrame, id_column: str, padded: bool = True) -> DataFrame:
    """(seq_id, tokens, tags) for each id: example and variation by remainder.

    Variations: as is, upper, lower, two tokens more at the end, two more at the front. Tags are
    shifted with the front tokens, cut to the tokens, and (if `padded`) filled up with `O`.
    """
    key = F.col(id_column)
    sample = F.pmod(key, F.lit(len(EXAMPLE_TOKENS)))
    variation = F.pmod(key, F.lit(TOKEN_VARIATIONS))

    def words(*texts: str) -> Column:
        return F.array(*[F.lit(text) for text in texts])

    tokens = _pick([words(*example) for example, _ in EXAMPLE_TOKENS], sample)
    tags = _pick([words(*labels) for _, labels in EXAMPLE_TOKENS], sample)
    varied = _pick(
        [
            tokens,
            F.transform(tokens, F.upper),
            F.transform(tokens, F.lower),
            F.concat(tokens, words("Additional", "text")),
            F.concat(words("Document", ":"), tokens),
        ],
        variation,
    )
    shifted = F.when(variation == 4, F.concat(words("O", "O"), tags)).otherwise(
        F.slice(tags, F.lit(1), F.size(tokens))
    )
    cut = F.slice(shifted, F.lit(1), F.size(varied))
    fill = F.array_repeat(F.lit("O"), F.greatest(F.size(varied) - F.size(cut), F.lit(0)))
    return ids.select(
        key.alias("seq_id"),
        varied.alias("tokens"),
        (F.concat(cut, fill) if padded else cut).alias("tags"),
    )


def create_synthetic_sequences(spark: SparkSession, num_samples: int = 500) -> DataFrame:
    return synthetic_sequences(spark.range(num_samples), "id")
