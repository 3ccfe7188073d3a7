"""Scores worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from formwright.functions.validators import default_validators, field_score

GOLDEN = {
    "SSN": {
        "123-45-6789": 0.2, "000-00-0000": 0.0, "123456789": 0.2, "invalid": 0.0,
        "518-51-8062": 0.3, "457-45-7890": 0.2, "900-12-8063": 0.0, "666-12-8063": 0.0,
        "518-00-8062": 0.0, "518-52-0000": 0.0, "518-52-8063": 0.9, "  518-52-8063\n": 0.9,
    },
    "EMPLOYER_EIN": {"12-3456789": 0.8, "99-1234567": 0.3, "02-1000021": 0.3, "12-345": 0.0, "98-1234567": 0.8},
    "WAGE_AMOUNT": {
        "$50,000.00": 0.9, "$1,000,000.00": 0.9, "invalid amount": 0.1, "50.000": 0.4, "-5": 0.9,
        "--5": 0.3, "10000000": 0.9, "10000000.01": 0.2, "$": 0.1, "1d": 0.1, "1_000": 0.9,
        "1__000": 0.1, "_1": 0.1, "nan": 0.9, "inf": 0.2, "--inf": 0.3, "1e8": 0.2, "1.5e3": 0.4,
        "5.": 0.9, ".5": 0.9, ".": 0.1, "$ 5": 0.9, "5.00 $": 0.4, "+5": 0.9, "0x10": 0.1,
    },
    "MEDICARE_TAX": {"12.345": 0.4, "12.34": 0.9},
    "DATE": {
        "12/31/2023": 0.9, "2023-12-31": 0.9, "invalid date": 0.0, "13/45/2023": 0.0,
        "12/31/75": 0.9, "01/01/1899": 0.2, "06/01/2026": 0.6, "01/01/2028": 0.2,
        "December 5, 2023": 0.9, "Dec 5 2023": 0.0, "02/30/2023": 0.0, "02/29/2024": 0.9,
        "5 december 2023": 0.9, "05 DEC 2023": 0.9, "Sept 5, 2023": 0.0, "1/2/2023": 0.9,
        "99-01-05": 0.9, "01/01/0000": 0.0, "12/31/68": 0.2, "12/31/69": 0.9, "12-31/2023": 0.0,
        "2023-1-5": 0.9, "Dec 5,2023": 0.0, "May 5, 2023": 0.9,
    },
    "EMAIL": {"john.doe@email.com": 0.9, "invalid-email": 0.1, "test@domain": 0.1, "no-at-sign": 0.1},
    "PHONE_NUMBER": {
        "555-123-4567": 0.9, "5551234567": 0.9, "invalid phone": 0.2, "123": 0.2,
        "1-555-123-4567": 0.8, "2-555-123-4567": 0.2,
    },
    "ACCOUNT_NUMBER": {"1234567890": 0.8, "1234567": 0.3, "1" * 17: 0.8, "1" * 18: 0.3},
    "ROUTING_NUMBER": {"021000021": 0.9, "123456789": 0.6, "12345": 0.1},
    "EMPLOYER_NAME": {"John Doe": 0.8, "J": 0.1, "R2D2": 0.2, "-.'-.": 0.3, "O'Neil, Sons": 0.8},
    "EMPLOYEE_NAME": {"a.b": 0.3, "José": 0.2},
    "ADDRESS": {"123 Main St": 0.7, "1 Elm": 0.2, "Main Street": 0.3},
    "OTHER": {"x": 0.5, "": 0.0, " \t ": 0.0, None: 0.0},
}


def test_golden_scores(spark):
    rows = [(f, value, score) for f, cases in GOLDEN.items() for value, score in cases.items()]
    df = spark.createDataFrame(rows, "field string, value string, expected double")
    rules = default_validators(F.lit("2026-01-01").cast("date"))
    scored = df.withColumn("score", field_score(F.col("field"), F.col("value"), rules))
    wrong = scored.filter("score is null or score <> expected").collect()
    assert wrong == []


def test_scores_inside_a_lambda_are_the_same(spark):
    rows = [(f, value, score) for f, cases in GOLDEN.items() for value, score in cases.items()]
    df = spark.createDataFrame(rows, "field string, value string, expected double")
    rules = default_validators(F.lit("2026-01-01").cast("date"))
    nested = df.agg(F.collect_list(F.struct("*")).alias("a")).select(
        F.transform(
            "a",
            lambda r: F.struct(
                r["expected"].alias("expected"),
                field_score(r["field"], r["value"], rules).alias("score"),
            ),
        ).alias("a")
    )
    assert nested.select(F.inline("a")).filter("score <> expected").count() == 0


@pytest.mark.parametrize("name, expected", [("OTHER", 1.0), ("SSN", 0.5), ("EMAIL", 0.5)])
def test_own_rules_replace_and_extend(spark, name, expected):
    rules = {
        "OTHER": lambda value: F.lit(1.0),
        "SSN": lambda value: F.lit(None).cast("double"),  # a rule that fails
    }
    df = spark.createDataFrame([("518-52-8063",)], "value string")
    assert df.select(field_score(F.lit(name), F.col("value"), rules)).first()[0] == expected


def test_row_scores_equal_expression_scores(spark, sf_dir):
    from formwright.functions.validators import default_validators, field_score, with_field_score
    from formwright.plans import corpus

    rows = corpus.field_values(corpus.documents(spark, sf_dir))
    as_of = F.lit("2026-01-01").cast("date")
    both = with_field_score(rows, "field_name", "value", as_of=as_of).withColumn(
        "other", field_score(F.col("field_name"), F.col("value"), default_validators(as_of))
    )
    assert both.filter("NOT score <=> other").count() == 0 and both.count() > 1000


def test_usual_values_score_as_by_the_whole_rule(spark):
    from formwright.functions.validators import field_score, with_field_score

    amounts = ["5", "$5.", "5.12", "5.123", "1,234,567.89", "9999999.99", "10000000", "10000001", "$12,345,678.00", ",5", "5,", "$$5",
               "-5", "1,,2", ".5", "$", "5\n", " 5 ", " 5 ", "5.12\n", "a\nb", "", " ", None, "٥"]
    rows = [(name, text) for text in amounts for name in ("WAGE_AMOUNT", "SSN", "ADDRESS", "OTHER")]
    df = spark.createDataFrame(rows, "field_name string, value string")
    scored = with_field_score(df, "field_name", "value").withColumn("one", field_score(F.col("field_name"), F.col("value")))
    for row in scored.collect():
        assert row.one == row.score, row
