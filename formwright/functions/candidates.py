"""Field candidates of one document: from patterns, from a model, and their merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from formwright import vocabulary as v
from formwright.functions.arrays import let
from formwright.functions.text import MARK, digits, java_pattern, marked, piece_starts, pieces, unmarked

CANDIDATES = (
    "array<struct<type_ord:int,field_name:string,value:string,confidence:double,"
    "start:int,end:int,from_pattern:boolean>>"
)
MODEL_ENTITIES = (
    "array<struct<entity_group:string,word:string,score:double,start:int,end:int>>"
)


def likely_ssn(value: Column) -> Column:
    """Nine digits that are in the ranges a social security number may take."""
    d = digits(value)
    return (
        (F.length(d) == 9)
        & ~d.rlike("^(000|666|9)")
        & (F.substring(d, 4, 2) != "00")
        & (F.substring(d, 6, 4) != "0000")
    )


def field_of_group(group: Column) -> Column:
    """Field name of a model's entity group; other names stay as they are."""
    name = F.upper(group)
    known = F.create_map(*[F.lit(x) for pair in v.GROUP_TO_FIELD.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def type_ord(field_name: Column) -> Column:
    """Position of the field type, from 0; -1 for a name outside the vocabulary."""
    return F.array_position(F.array(*[F.lit(t) for t in v.FIELD_TYPES]), field_name).cast("int") - 1


#: Texts of up to so many characters, with up to so many model entities, are ranked type by type (`ranked_values`).
SHORT_TEXT, FEW_ENTITIES = 1024, 64
#: Pattern matches arrive after all model entities.
_AFTER_MODEL = 1 << 30

_MONTH_INITIALS = "[" + "".join(sorted({name[0] for name in v.MONTHS})) + "]"

# In the order of extraction; the last entry tells whether case is ignored.
_SEARCHES = (
    ("SSN", v.SSN_PATTERNS, False),
    ("WAGE_AMOUNT", v.AMOUNT_PATTERNS, False),
    ("DATE", v.DATE_PATTERNS, True),
    ("EMPLOYER_EIN", v.EIN_PATTERNS, False),
)


def _searched_for(pattern: str, ignore_case: bool) -> str:
    return java_pattern(pattern, r"\d" if pattern.startswith(r"\b\d") else _MONTH_INITIALS, ignore_case)


def pattern_candidates(text: Column, *fields: str) -> Column:
    """Pattern candidates of the given fields (all if none is given), repeats included.

    They come in the order their patterns are tried, and by place within a pattern.
    """

    def searched(t: Column, field: str, pattern: str, ignore_case: bool) -> Column:
        return F.struct(
            F.lit(v.FIELD_TYPES.index(field)).alias("type_ord"),
            F.lit(field).alias("field_name"),
            F.lit(v.PATTERN_CONFIDENCE[field]).alias("confidence"),
            pieces(t, _searched_for(pattern, ignore_case)).alias("cut"),
        )

    def located(s: Column) -> Column:
        cut = s["cut"]
        places = F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2))
        listed = let(
            piece_starts(cut),
            lambda at: F.transform(places, lambda i: one(s, F.get(cut, i), F.get(at, i))),
        )
        return F.when(F.size(cut) > 1, listed).otherwise(F.array().cast(CANDIDATES))

    def one(s: Column, value: Column, start: Column) -> Column:
        return F.struct(
            s["type_ord"].alias("type_ord"),
            s["field_name"].alias("field_name"),
            value.alias("value"),
            s["confidence"].alias("confidence"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            F.lit(True).alias("from_pattern"),
        )

    def all_of(t: Column) -> Column:
        searches = [
            searched(t, field, pattern, ignore_case)
            for field, patterns, ignore_case in _SEARCHES
            if not fields or field in fields
            for pattern in patterns
        ]
        found = F.flatten(F.transform(F.array(*searches), located))
        kept = F.filter(
            found, lambda c: (c["field_name"] != "EMPLOYER_EIN") | ~likely_ssn(c["value"])
        )
        return F.when(t.isNotNull(), kept).otherwise(F.array().cast(CANDIDATES))

    return let(unmarked(text), all_of)


#: Numbers of sources that are no pattern: the model, and below it whatever is to be counted with the candidates.
MODEL = -1

_GIVEN = "struct<field_name:string,confidence:double,arrival:int,start:int,end:int>"
#: The field of each pattern by its number.
SEARCHED_FIELDS = tuple(field for field, patterns, _ in _SEARCHES for _ in patterns)


def _source(number: int, content: Column, starts: Column, given: Column) -> Column:
    return F.struct(
        F.lit(number).alias("number"),
        content.cast("string").alias("content"),
        starts.cast("array<int>").alias("starts"),
        given.cast(_GIVEN).alias("given"),
    )


def search_sources(text: Column) -> Column:
    """One element for each pattern: its number, and the text with its matches marked.

    `starts` are those of the pieces, of long texts only: in a short one they are cheaper to count where a piece is read.
    """

    def source(number: int, pattern: str) -> Column:
        cut = marked(unmarked(text), pattern)
        starts = F.when(F.length(text) > SHORT_TEXT, piece_starts(F.split(cut, MARK, -1)))
        return _source(number, cut, starts, F.lit(None))

    searches = [_searched_for(p, ignore_case) for _, patterns, ignore_case in _SEARCHES for p in patterns]
    return F.array(*[source(number, pattern) for number, pattern in enumerate(searches)])


def given_source(
    number: int,
    field_name: Column,
    value: Column,
    start: Column,
    end: Column,
    confidence: Column | None = None,
    arrival: Column | None = None,
) -> Column:
    """One value with its place, in the form of `search_sources`."""
    given = F.struct(
        field_name.alias("field_name"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        (F.lit(None) if arrival is None else arrival).cast("int").alias("arrival"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
    )
    return _source(number, value, F.lit(None), given)


def model_sources(entities: Column) -> Column:
    """The model's entities in that form, those outside the vocabulary too."""
    return F.transform(
        F.coalesce(entities, F.array().cast(MODEL_ENTITIES)),
        lambda e, i: given_source(MODEL, field_of_group(e["entity_group"]), e["word"], e["start"], e["end"], e["score"], i),
    )


def ssn_candidates(text: Column) -> Column:
    return pattern_candidates(text, "SSN")


def amount_candidates(text: Column) -> Column:
    return pattern_candidates(text, "WAGE_AMOUNT")


def date_candidates(text: Column) -> Column:
    return pattern_candidates(text, "DATE")


def ein_candidates(text: Column) -> Column:
    """Numbers in the form of an employer number that are not likely an SSN."""
    return pattern_candidates(text, "EMPLOYER_EIN")


def model_candidates(entities: Column) -> Column:
    """A model's entities as candidates, in arrival order; groups outside the vocabulary go."""

    def candidate(e: Column) -> Column:
        return let(
            field_of_group(e["entity_group"]),
            lambda name: F.struct(
                type_ord(name).alias("type_ord"),
                name.alias("field_name"),
                e["word"].alias("value"),
                e["score"].cast("double").alias("confidence"),
                e["start"].cast("int").alias("start"),
                e["end"].cast("int").alias("end"),
                F.lit(False).alias("from_pattern"),
            ),
        )

    mapped = F.filter(F.transform(entities, candidate), lambda c: c["type_ord"] >= 0)
    return F.coalesce(mapped, F.array().cast(CANDIDATES))


def ranked_fields(candidates: Column, min_confidence: float = 0.3) -> Column:
    """Distinct, ranked candidates of one document, in type order and by rank within a type.

    Of equal values of a type the first model entity above `min_confidence` is kept. A pattern match
    is kept only where the model did not report that value at all: a rejected model entity still
    suppresses it. Rank is by confidence, ties by arrival.

    Sorting brings equal values together, so the work is n log n in the number of candidates.
    """

    def keyed(c: Column, i: Column) -> Column:
        accepted = F.coalesce(c["confidence"] > min_confidence, F.lit(False))
        standing = (
            F.when(c["from_pattern"], F.lit(2))
            .when(accepted & ~F.isnan(c["confidence"]), F.lit(0))
            .otherwise(F.lit(1))
        )
        return F.struct(
            c["type_ord"].alias("type_ord"),
            c["value"].alias("value"),
            standing.alias("standing"),
            i.alias("arrival"),
            c.alias("candidate"),
        )

    def first_of_equals(rows: Column) -> Column:
        def is_first(row: Column, i: Column) -> Column:
            previous = F.get(rows, i - 1)
            repeated = (previous["type_ord"] == row["type_ord"]) & previous["value"].eqNullSafe(
                row["value"]
            )
            return (row["standing"] != 1) & ((i == 0) | ~repeated)

        return F.filter(rows, is_first)

    def by_rank(rows: Column) -> Column:
        return F.sort_array(
            F.transform(
                rows,
                lambda r: F.struct(
                    r["type_ord"].alias("type_ord"),
                    (-r["candidate"]["confidence"]).alias("descending"),
                    r["arrival"].alias("arrival"),
                    r["candidate"].alias("candidate"),
                ),
            )
        )

    ordered = F.sort_array(F.transform(candidates, keyed))
    return let(
        ordered,
        lambda rows: let(by_rank(first_of_equals(rows)), lambda kept: _numbered(kept, lambda r: r["candidate"])),
    )


def _numbered(rows: Column, candidate: Callable[[Column], Column]) -> Column:
    """Ranked fields of rows in type order and by rank; `candidate` is what they are made of."""
    types = F.transform(rows, lambda r: r["type_ord"])
    firsts = let(
        types,
        lambda t: F.transform(
            F.sequence(F.lit(0), F.lit(len(v.FIELD_TYPES) - 1)),
            lambda ord_: F.array_position(t, ord_).cast("int"),
        ),
    )
    return let(
        firsts,
        lambda first: F.transform(
            rows,
            lambda r, i: F.struct(
                r["type_ord"].alias("type_ord"),
                candidate(r)["field_name"].alias("field_name"),
                (i + 2 - F.get(first, r["type_ord"])).alias("field_rank"),
                candidate(r)["value"].alias("value"),
                candidate(r)["confidence"].alias("confidence"),
                candidate(r)["start"].alias("start"),
                candidate(r)["end"].alias("end"),
            ),
        ),
    )


def ranked_values(text: Column, entities: Column | None = None, min_confidence: float = 0.3) -> Column:
    """What `ranked_fields` gives for the model's and then the patterns' candidates of a text, but for start and end.

    Patterns are tried in type order and have one confidence a type, so their matches come ranked: repeats
    and what the model reported are taken out type by type, and only the model's few entities are sorted
    in. Start and end are NULL. Long texts and many entities go through `ranked_fields`.
    """
    model = F.array().cast(CANDIDATES) if entities is None else model_candidates(entities)

    def ranked(t: Column, m: Column) -> Column:
        long = (F.length(t) > SHORT_TEXT) | (F.size(m) > FEW_ENTITIES)
        rows = F.sort_array(F.concat(*_by_type(t, m), _accepted(m, min_confidence)))
        return F.when(long, ranked_fields(F.concat(m, pattern_candidates(t)), min_confidence)).otherwise(
            let(rows, lambda kept: _numbered(kept, lambda r: r))
        )

    return let(unmarked(F.coalesce(text, F.lit(""))), lambda t: let(model, lambda m: ranked(t, m)))


def _rankable(ord_: Column, name: Column, arrival: Column, value: Column, confidence: Column) -> Column:
    """A candidate whose first fields are its place among those of a document."""
    nowhere = F.lit(None).cast("int")
    return F.struct(
        ord_.alias("type_ord"),
        (-confidence).alias("descending"),
        arrival.alias("arrival"),
        name.alias("field_name"),
        value.alias("value"),
        confidence.alias("confidence"),
        nowhere.alias("start"),
        nowhere.alias("end"),
    )


def _accepted(model: Column, min_confidence: float) -> Column:
    """The first of equal values of a type among the model's few candidates above `min_confidence`."""

    def is_first(c: Column, i: Column, above: Column) -> Column:
        return ~F.exists(
            F.slice(above, F.lit(1), i),
            lambda b: (b["type_ord"] == c["type_ord"]) & b["value"].eqNullSafe(c["value"]),
        )

    def firsts(above: Column) -> Column:
        return F.transform(
            F.filter(above, lambda c, i: is_first(c, i, above)),
            lambda c, i: _rankable(c["type_ord"], c["field_name"], i, c["value"], c["confidence"]),
        )

    above = F.filter(model, lambda c: (c["confidence"] > min_confidence) & ~F.isnan(c["confidence"]))
    return let(above, firsts)


def _by_type(t: Column, model: Column) -> list[Column]:
    """Per type with patterns: their matches, each value once, but for the model's values."""
    none = F.array().cast("array<string>")

    def reported(ord_: int) -> Column:
        same = F.filter(model, lambda c: c["type_ord"] == ord_)
        return F.when(F.size(model) > 0, F.transform(same, lambda c: c["value"])).otherwise(none)

    def of_type(field: str, patterns: tuple[str, ...], ignore_case: bool) -> Column:
        searched = [F.lit(_searched_for(pattern, ignore_case)) for pattern in patterns]
        values = F.concat(*[F.regexp_extract_all(t, p, F.lit(0)) for p in searched])
        if field == "EMPLOYER_EIN":
            values = F.filter(values, lambda x: ~likely_ssn(x))
        ord_, confidence = F.lit(v.FIELD_TYPES.index(field)), F.lit(v.PATTERN_CONFIDENCE[field])
        return F.transform(
            F.array_except(values, reported(v.FIELD_TYPES.index(field))),
            lambda value, i: _rankable(ord_, F.lit(field), i + _AFTER_MODEL, value, confidence),
        )

    return [of_type(*search) for search in _SEARCHES]
