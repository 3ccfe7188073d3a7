"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Each text gives counts, the counts a vector of transformed statistics. For every language and source the
vectors' location and covariance are estimated by minimum covariance determinant: from three starts on (robust
variances; correlations of bounded values; correlations of directions), concentration steps take the closest part
of each group and estimate anew from it, until no determinant falls any more. The start with the least determinant
holds. A document is rejected if its Mahalanobis distance from its group exceeds a limit.

A step is one aggregation by group and cell of the distance, of counts, sums and products; what lies within the
support follows from the few cells of a group, the cell on its border counted in part. So no group's values
are ever gathered, and results do not depend on partitions. Estimates are drawn towards those of the language by the
weight of `PRIOR` documents, which decides in small groups and vanishes in large ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from formwright.llm.common import join_counted, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

STATISTICS = ("x0", "x1", "x2", "x3", "x4", "x5", "x6")
#: Added to each variance, so that a statistic without variation has an inverse.
FLOORS = (0.01, 0.01, 0.002, 0.002, 0.002, 0.02, 0.02)
#: The part of a group that estimates are taken from.
SUPPORT = 0.75
#: Steps end when no logarithm of a determinant falls by more than this, or after so many.
LEAST_FALL = 0.01
MOST_STEPS = 12
STARTS = 3
#: The number of documents that a language's estimate counts as, beside those of the group.
PRIOR = 30
#: The part of a normal group that is rejected.
TAIL = 1e-6
#: Rows of a group that meet one copy of its estimate.
SALT_ROWS = 1000

SIZE = len(STATISTICS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
GROUP = ["lang", "source"]
SUMS = [f"s{i}" for i in range(SIZE)] + [f"p{i}{j}" for i, j in PAIRS]


def chi2_tail(x: float) -> float:
    """The probability that a chi-squared variable with seven degrees of freedom exceeds `x`."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3 + x * x / 15)


def chi2_limit(tail: float) -> float:
    """The value that such a variable exceeds with probability `tail`."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_tail(middle) > tail else (low, middle)
    return (low + high) / 2


#: The squared distance from which a document is rejected, about 40.
LIMIT = chi2_limit(TAIL)
#: Histogram cells per unit of a statistic, and per power of two of a squared distance.
CELLS = 64
DISTANCE_CELLS = 32


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the statistics' other counts.

    Null texts count as empty. Window hashes of one text are 64 bits wide.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    source = docs.withColumns({"_words": F.array_remove(F.split(body, r"[\x20\x09-\x0D]+", -1), ""), "_lines": lines})
    counted = source.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "capitals": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)),
        ),
    ).otherwise(F.expr("cast(array() AS array<bigint>)"))
    hashed = counted.withColumns({"_windows": windows, "n_distinct": F.size(F.array_distinct("_hashes")).cast("long")})
    # Only texts with a repeated window sort theirs.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(
        repeats, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    )
    sorted_ = hashed.withColumn("_placed", placed)
    again = F.filter(
        F.transform(
            "_placed",
            lambda p, j: F.when(
                (p["x"] == F.get("_placed", j + 1)["x"]) | (p["x"] == F.get("_placed", j - 1)["x"]), p["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    starts = sorted_.withColumn("_starts", F.sort_array(again))
    covered = F.aggregate(
        F.transform(
            "_starts", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - s, F.lit(WINDOW)))
        ),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(
        "_words", "_lines", "_hashes", "_windows", "_placed", "_starts"
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def _statistics() -> dict[str, Column]:
    """Logarithms of counts, the mean word length's logarithm, square roots of the shares of capitals, symbols,
    duplicate lines and repeated words."""
    values = (
        F.log1p("n_words"),
        F.log1p("n_distinct"),
        F.log(F.col("word_chars") / F.col("n_words")),
        F.sqrt(F.col("capitals") / F.col("word_chars")),
        F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / F.col("n_words")),
    )
    return dict(zip(STATISTICS, values))


def _quantiles(counts: DataFrame, by: list[str], parts: dict[str, float]) -> DataFrame:
    """For each of `by` the least cell up to which at least each part of the rows lies; `counts` has `by`, cell, c."""
    merged = counts.groupBy(*by, "cell").agg(F.sum("c").alias("c"))
    summed = merged.select(
        *by,
        "cell",
        F.sum("c").over(W.partitionBy(*by).orderBy("cell")).alias("up_to"),
        F.sum("c").over(W.partitionBy(*by)).alias("all"),
    )
    return summed.groupBy(*by).agg(
        F.max("all").alias("n"),
        *[F.min(F.when(F.col("up_to") >= part * F.col("all"), F.col("cell"))).alias(name) for name, part in parts.items()],
    )


def _drawn(own: str, weight: str, languages: str) -> str:
    """An estimate from `weight` documents, drawn towards the language's."""
    return f"(({own}) * {weight} + ({languages}) * {PRIOR}) / ({weight} + {PRIOR})"


def _with_language(groups: DataFrame, names: list[str]) -> DataFrame:
    """Adds to the sums `names` of each group those of its language, as {name}_l."""
    by = ["lang", "start"]
    whole = groups.groupBy(*by).agg(*[F.sum(c).alias(f"{c}_l") for c in names])
    return groups.join(whole, by)


def _centres(rows: DataFrame) -> DataFrame:
    """(lang, source, n, m*, v*): medians, and variances by quartiles."""
    cells = F.array(*[F.floor(F.col(x) * CELLS).cast("long") for x in STATISTICS])
    long = rows.select(*GROUP, F.posexplode(cells).alias("i", "cell"))
    counts = written(long.groupBy(*GROUP, "i", "cell").agg(F.count("*").alias("c")), "cells")
    parts = {"q1": 0.25, "q2": 0.5, "q3": 0.75}

    def values(by: list[str], end: str) -> DataFrame:
        return _quantiles(counts, [*by, "i"], parts).select(
            *by,
            "i",
            F.col("n").alias(f"n{end}"),
            ((F.col("q2") + 0.5) / CELLS).alias(f"m{end}"),
            F.pow((F.col("q3") - F.col("q1")) / (CELLS * 1.349), 2).alias(f"v{end}"),
        )

    both = values(GROUP, "").join(values(["lang"], "_l"), ["lang", "i"])

    def of(name: str, i: int) -> Column:
        return F.expr(f"max(CASE WHEN i = {i} THEN {_drawn(name, 'n', f'{name}_l')} END)")

    return both.groupBy(*GROUP).agg(
        F.max("n").alias("n"),
        *[of("m", i).alias(f"m{i}") for i in range(SIZE)],
        *[(of("v", i) + FLOORS[i]).alias(f"v{i}") for i in range(SIZE)],
    )


def _starts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Estimates about the medians: robust variances (0), and two robust correlations of standardised values.

    The values are bounded by the hyperbolic tangent (1), or divided by the length of their vector (2).
    """
    centres = written(_centres(rows), "centres")
    joined = _joined(rows, centres.drop("n"), groups)
    z = joined.selectExpr(*GROUP, *[f"(x{i} - m{i}) / sqrt(v{i}) AS z{i}" for i in range(SIZE)])
    length = F.expr(f"greatest(sqrt({' + '.join(f'z{i} * z{i}' for i in range(SIZE))}), 1e-9D)")
    bounded = [f"tanh(z{i})" for i in range(SIZE)]
    direction = [f"z{i} / length * sqrt({SIZE})" for i in range(SIZE)]
    kinds = [
        F.expr(f"named_struct('start', {k}, {', '.join(f'{chr(39)}y{i}{chr(39)}, {x}' for i, x in enumerate(values))})")
        for k, values in ((1, bounded), (2, direction))
    ]
    products = (
        z.withColumn("length", length)
        .select(*GROUP, F.inline(F.array(*kinds)))
        .groupBy(*GROUP, "start")
        .agg(
            F.count("*").cast("double").alias("w"),
            *[F.expr(f"sum(y{i} * y{j}) AS p{i}{j}") for i, j in PAIRS],
        )
    )
    names = ["w", *[f"p{i}{j}" for i, j in PAIRS]]
    both = _with_language(written(products, "correlations"), names).join(centres, GROUP)

    def value(i: int, j: int) -> str:
        found = _drawn(f"p{i}{j} / w", "w", f"p{i}{j}_l / w_l")
        return f"{found} * sqrt(v{i} * v{j}) + {FLOORS[i] if i == j else 0.0}D AS c{i}{j}"

    means = [f"m{i}" for i in range(SIZE)]
    related = both.selectExpr(*GROUP, "start", *means, *[value(i, j) for i, j in PAIRS])
    variances = [f"{f'v{i}' if i == j else '0D'} AS c{i}{j}" for i, j in PAIRS]
    plain = centres.selectExpr(*GROUP, "0 AS start", *means, *variances)
    return _solved(plain.unionByName(related))


def _solved(estimates: DataFrame) -> DataFrame:
    """(lang, source, start, m*, k*, logdet, freedom) of means and covariances c*, written.

    k is the inverse of the covariance's lower triangular root. `freedom` counts each statistic by the part of its
    variance that is not the floor.
    """
    found = estimates
    for j in range(SIZE):
        rest = {
            i: " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]]) for i in range(j, SIZE)
        }
        found = found.selectExpr("*", f"sqrt(greatest({rest[j]}, 1e-9D)) AS l{j}{j}")
        found = found.selectExpr("*", *[f"({rest[i]}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, SIZE)])
    for i in range(SIZE):
        row = [f"1 / l{i}{i} AS k{i}{i}"]
        for j in range(i):
            row.append(f"-({' + '.join(f'l{i}{k} * k{k}{j}' for k in range(j, i))}) / l{i}{i} AS k{i}{j}")
        found = found.selectExpr("*", *row)
    logdet = F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(SIZE)))
    freedom = F.expr(" + ".join(f"1 - least({FLOORS[i]}D / c{i}{i}, 1D)" for i in range(SIZE)))
    return written(
        found.select(*GROUP, "start", *_parameters(), logdet.alias("logdet"), freedom.alias("freedom")), "estimates"
    )


def _parameters() -> list[str]:
    return [f"m{i}" for i in range(SIZE)] + [f"k{i}{j}" for i, j in PAIRS]


def _joined(rows: DataFrame, by_group: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` with what `by_group` tells of their group.

    Each group has a copy for every `SALT_ROWS` rows, which are dealt among them; so if the copies are too many for
    Spark to broadcast, no group is a hot key of the join.
    """
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    return rows.join(by_group.join(groups.select(*GROUP, salts), GROUP), [*GROUP, "salt"])


def _distance() -> Column:
    """The squared distance from the estimate m*, k*."""
    parts = [" + ".join(f"k{i}{j} * (x{j} - m{j})" for j in range(i + 1)) for i in range(SIZE)]
    return F.expr(" + ".join(f"pow({p}, 2)" for p in parts))


def _cell() -> Column:
    return F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * DISTANCE_CELLS).cast("long")


def _concentrate(rows: DataFrame, estimates: DataFrame, groups: DataFrame) -> DataFrame:
    """Estimates from the closest part of each group, for each start."""
    measured = _joined(rows, estimates, groups).withColumn("d2", _distance())
    cells = (
        measured.select(*GROUP, "start", _cell().alias("cell"), *STATISTICS)
        .groupBy(*GROUP, "start", "cell")
        .agg(
            F.count("*").alias("c"),
            *[F.expr(f"sum(x{i}) AS s{i}") for i in range(SIZE)],
            *[F.expr(f"sum(x{i} * x{j}) AS p{i}{j}") for i, j in PAIRS],
        )
    )
    group = W.partitionBy(*GROUP, "start")
    before = F.sum("c").over(group.orderBy("cell")) - F.col("c")
    part = (SUPPORT * F.sum("c").over(group) - before) / F.col("c")
    taken = cells.withColumn("part", F.least(part, F.lit(1.0))).where("part > 0")
    sums = taken.groupBy(*GROUP, "start").agg(
        F.sum(F.col("c") * F.col("part")).alias("w"), *[F.expr(f"sum({s} * part) AS {s}") for s in SUMS]
    )
    both = _with_language(written(sums, "moments"), ["w", *SUMS])

    def mean(i: int, end: str = "") -> str:
        return f"s{i}{end} / w{end}"

    def spread(i: int, j: int, end: str = "") -> str:
        return f"p{i}{j}{end} / w{end} - ({mean(i, end)}) * ({mean(j, end)})"

    means = [f"{_drawn(mean(i), 'w', mean(i, '_l'))} AS m{i}" for i in range(SIZE)]
    spreads = [
        f"{_drawn(spread(i, j), 'w', spread(i, j, '_l'))} + {FLOORS[i] if i == j else 0.0}D AS c{i}{j}" for i, j in PAIRS
    ]
    return _solved(both.selectExpr(*GROUP, "start", *means, *spreads))


def _estimates(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimate of least determinant for each group."""
    now = _starts(rows, groups)
    for step in range(MOST_STEPS):
        later = _concentrate(rows, now, groups)
        fall = now.select(*GROUP, "start", F.col("logdet").alias("was")).join(later, [*GROUP, "start"])
        now, most = later, fall.agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        # The starts' matrices have a scale of their own, so the first fall tells nothing.
        if step and (most is None or most <= LEAST_FALL):
            break
    names = ["logdet", "start", "freedom", *_parameters()]
    return now.groupBy(*GROUP).agg(F.min(F.struct(*names)).alias("best")).select(*GROUP, "best.*")


def _scales(measured: DataFrame, estimates: DataFrame) -> DataFrame:
    """(lang, source, scale): what makes the group's median distance that of a normal distribution."""
    counts = written(
        measured.groupBy(*GROUP, _cell().alias("cell")).agg(F.count("*").alias("c")), "distance-cells"
    )

    def middle(by: list[str], end: str) -> DataFrame:
        value = F.pow(F.lit(2.0), (F.col("q") + 0.5) / DISTANCE_CELLS)
        return _quantiles(counts, by, {"q": 0.5}).select(*by, F.col("n").alias(f"n{end}"), value.alias(f"d{end}"))

    both = middle(GROUP, "").join(middle(["lang"], "_l"), "lang").join(estimates.select(*GROUP, "freedom"), GROUP)
    k = F.greatest("freedom", F.lit(1.0))
    normal = k * F.pow(1 - 2 / (9 * k), 3)
    found = F.expr(_drawn("d", "n", "d_l"))
    return both.select(*GROUP, (normal / F.greatest(found, F.lit(1e-3))).alias("scale"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2).

    One row for each row of `docs`. Texts with fewer than `LEAST_WORDS` words, or with more than
    `MOST_REPEATED_PERCENT` % of them in repeated windows, fail the base rules (null and empty ones do) and take
    no part in the estimates; their `distance2` is null. The others are kept unless their squared distance, scaled so that
    the group's median is that of a normal distribution, exceeds `LIMIT`. A document alone in its language is at
    its own centre and kept. Null languages and sources make groups of their own. Repeated rows each count and
    each have their row; an empty table gives an empty result.
    """
    picked = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
    )
    counted = with_counts(picked).drop("text").withColumn("base_failed", base_failed())
    rows = written(counted, "statistics")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = rows.where("NOT base_failed").withColumns(_statistics()).select(*names, *GROUP, *STATISTICS)
    sizes = passed.groupBy(*GROUP).agg(F.count("*").alias("n"))
    groups = written(sizes.withColumn("salts", F.ceil(F.col("n") / SALT_ROWS)), "groups")
    salt = F.pmod(F.monotonically_increasing_id(), F.col("salts")).alias("salt")
    vectors = join_counted(passed, groups, GROUP, "n").select(*names, *GROUP, *STATISTICS, salt)
    vectors = written(vectors, "vectors")
    estimates = written(_estimates(vectors, groups), "best")
    measured = _joined(vectors, estimates, groups).select(*names, *GROUP, "salt", _distance().alias("d2"))
    measured = written(measured, "distances")
    scaled = _joined(measured, written(_scales(measured, estimates), "scales"), groups)
    good = scaled.withColumn("distance2", F.col("d2") * F.col("scale")).select(
        *names, (F.col("distance2") <= LIMIT).alias("kept"), "distance2"
    )
    bad = rows.where("base_failed").select(
        *names, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2")
    )
    return good.unionByName(bad)
