"""Nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formwright.llm import decontaminate, language, outliers, packing, quality, queries, repeats, revisits, simhash, toxicity, url_filters

LONG = " ".join(f"word{i * i % 7919}" for i in range(30_000))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 int, score string, intervals int, "
    "fp string, first int, `salt` string, host string, rule int"
)
ROWS = [
    (1, "some plain words of a text", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (1, "some plain words of a text", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (2, "some plain words of a text", None, None, None, None, None, None, None, None, None, None, None, None),
    (None, "no id here at all", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (None, "another one without an id", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (3, None, "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (4, "", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (5, " \n\t ", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (6, LONG, "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (7, LONG + " end", "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
    (8, "x" * 300_000, "en", "a", 5, "x", 1, "s", 2, "f", 1, "p", "h", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, LONG[:300]), (1, LONG[:300]), (2, None), (3, ""), (None, "nothing of this stands anywhere in the texts above")],
        "item_id long, text string",
    )


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert of[1] == of[2] == 1 and of[3] == of[4] == of[5] == 3 and of[6] == of[7] == 6
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "8", "None", "None"])
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_rows_repeated_very_often_stay_once(spark):
    often = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one text many times over").alias("text"))
    twice = spark.range(1200).select((F.col("id") % 600 + 10).alias("doc_id"), F.sha2((F.col("id") % 600).cast("string"), 256).alias("text"))
    got = [r.doc_id for r in simhash.one_of_each(often.unionByName(twice)).collect()]
    assert sorted(got) == [5, *range(10, 610)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_links_are_all_pairs_within_the_budget(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in range(1, 6) for _ in range(12)]
    prints = sorted(set(base + near + [0, 1, 7, 15]))
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    expected = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert got == expected


def test_repeats(odd, none):
    found = repeats.with_intervals(odd)
    assert found.columns == [*odd.columns, "_intervals"] and found.count() == len(ROWS)
    by_id = {r.doc_id: r["_intervals"] for r in found.collect() if r.doc_id is not None}
    assert [tuple(p) for p in by_id[6]] == [(0, 30_000)] and [tuple(p) for p in by_id[7]] == [(0, 30_000)]
    assert by_id[1] == [] and by_id[3] == []
    kept = {r.doc_id: r.text for r in repeats.without_repeats(odd).collect() if r.doc_id is not None}
    assert kept[6] == "" and kept[7] == "end" and kept[5] == " \n\t " and kept[3] is None
    assert repeats.with_intervals(none).count() == 0


def test_null_texts_behind_a_full_filter(odd, monkeypatch):
    monkeypatch.setattr(repeats, "BITS", 6)
    monkeypatch.setattr(repeats, "in_bitmap", lambda bits, values, n: values == values)
    rows = repeats.without_repeats(odd.repartition(1)).where("doc_id = 3").collect()
    assert [r.text for r in rows] == [None]


def test_decontamination(odd, none, benchmark):
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, benchmark).collect()} == {(6, 1), (7, 1)}
    kept = decontaminate.without_leaks(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 2
    assert decontaminate.leaks(none, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, benchmark.limit(0)).count() == len(ROWS)


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * rows[0].doc_tokens
    assert packing.pack(none).count() == 0


def test_outliers(odd, none):
    got = outliers.judge(odd).collect()
    assert len(got) == len(ROWS)
    # The long texts repeat themselves, the others are too short.
    assert all(r.base_failed and not r.kept for r in got)
    assert {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert outliers.judge(none).count() == 0


def test_outlier_limit_is_a_quantile():
    assert math.isclose(outliers.chi2_tail(outliers.LIMIT), outliers.TAIL, rel_tol=1e-6)
    # Known quantiles of the distribution with seven degrees of freedom.
    assert math.isclose(outliers.chi2_limit(0.5), 6.3458, rel_tol=1e-4)
    assert math.isclose(outliers.chi2_limit(0.001), 24.3219, rel_tol=1e-4)


def test_models(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, 1, 0), (6, 0, 1), (7, None, None), (8, 5, 5), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    everywhere = F.lit(True)
    net = quality.train(odd, labels, "quality", everywhere)
    assert quality.scores(odd, net, ["doc_id"]).count() == len(ROWS)
    assert quality.accepted(odd, net).columns == odd.columns
    assert quality.scores(none, net, ["doc_id"]).count() == 0
    model = toxicity.train(odd, labels, "toxic", everywhere)
    scores = toxicity.scores(odd, model, ["doc_id"]).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        fitted = module.train(none, labels.limit(0), label, everywhere)
        assert module.scores(odd, fitted, ["doc_id"]).count() == len(ROWS)


def test_url_filters(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x"), (2, "https://a.example.com/en/"), (3, "http://example.com/EN/"), (4, "http://example.com"),
        (5, "http://notexample.com/en/?q=/en/"), (6, "x.net/es/"), (7, None), (8, "http://h.net/es/a#b"), (8, "http://h.net/es/a#b"),
        (9, "http://net/fr/"), (10, "http:///fr/"), (11, "http://a..net/es/" + "d/" * 3000), (12, "http://" + "s." * 3000 + "net/fr/"),
        (13, "http://h.net?u=http://x.net/es/"), (14, "http://h.net/es"), (15, ""),
    ]
    d = spark.createDataFrame([(*r, "r", "h") for r in rows], "page_id long, url string, rule string, salt string")
    rules = spark.createDataFrame(list(queries.RULES), "host string, path string, action string")
    found = url_filters.judge(d, rules)
    assert found.columns == ["page_id", "url", "salt", "host", "path", "rule", "verdict"]
    got = sorted((r.page_id, r.rule, r.verdict) for r in found.collect() if r.rule)
    assert got == [
        (1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "com/", "allow"), (5, "com/", "allow"),
        (8, "net/es/", "block"), (8, "net/es/", "block"), (9, "net/fr/", "block"), (11, "net/es/", "block"), (12, "net/fr/", "block"),
    ]
    assert found.count() == len(rows)
    assert {r.verdict for r in url_filters.judge(d, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filters.judge(d.limit(0), rules).count() == 0
    # Rules that end within a path's part, equally long ones, and one given twice.
    more = spark.createDataFrame(
        [("a.com", "/bc", "allow"), ("x.a.com", "/", "block"), ("a.com", "/z", "block"), ("a.com", "/z", "allow"), (None, "/", "block"), ("q.com", None, "block")],
        "host string, path string, action string",
    )
    d = spark.createDataFrame([(1, "http://a.com/bcd"), (2, "http://x.a.com/bcd"), (3, "http://a.com/zz"), (4, "http://q.com")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(d, more).collect()}
    assert got == {1: ("a.com/bc", "allow"), 2: ("x.a.com/", "block"), 3: ("a.com/z", "block"), 4: ("q.com", "block")}


def test_revisits(spark):
    full = {"ETag": '"a"', "Content-Length": "9", "etag": '"b"', "Vary": None}
    rows = [
        (1, "http://h.com", "2024-01-01 00:00:00", "response", 200, full), (1, "http://h.com", "2024-01-01 00:00:00", "response", 200, full),
        (2, "HTTP://H.com:80/#x", "2024-01-01 00:00:00", "revisit", 304, {"etag": '"b"'}),
        (3, "http://H.com/", "2024-03-01 00:00:00", "revisit", 304, {"Etag": 'W/"b"', "content-length": "0", "Date": "d"}),
        (4, "http://h.com/", "2024-03-01 00:00:00", "revisit", 304, None), (5, None, "2024-03-01 00:00:00", "revisit", 304, {"etag": "x"}),
        (6, "http://h.com/", None, "revisit", 304, {"etag": "x"}), (7, "http://h.com/", "2024-02-01 00:00:00", "response", 404, {}),
        (8, "http://h.com/", "2024-04-01 00:00:00", None, None, None), (9, "http://h.com/", "2024-05-01 00:00:00", "revisit", 304, {"etag": '"c"'}),
    ]
    schema = "record_id long, url string, ts string, kind string, http_status int, headers map<string, string>, full string, at int"
    d = spark.createDataFrame([(*r, "f", 1) for r in rows], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.record_id: r for r in revisits.resolve(d).collect()}
    assert {k: (r.response_id, r.status) for k, r in got.items()} == {
        2: (None, "no_response"), 3: (1, "resolved"), 4: (1, "no_validator"), 5: (None, "no_response"), 6: (None, "no_response"), 9: (1, "mismatch"),
    }
    assert got[3].headers == {"etag": 'W/"b"', "content-length": "9", "date": "d"}
    assert revisits.resolve(d.limit(0)).count() == 0


def test_language(spark, odd, none):
    model = language.train(none)
    pages = spark.createDataFrame([(1, "http://a.b.de/", "<html lang=de>"), (1, "http://a.b.de/", "<html lang=de>"), (None, None, None)], "page_id long, url string, html string")
    assert language.identify(pages, model).count() == 3
    assert language.identify(pages.limit(0), model).count() == 0
    assert language.train(odd).shape == (4, language.CELLS)


def test_pipeline(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, state, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= state.count()
        state = after
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg(F.sum("length")).first()[0] == packing.pack(state).agg(F.sum("length")).first()[0]
    assert len(corpus_pipeline.STAGES) == 5


def test_short_items_leak_whole(spark):
    items = ["Paris, France", "yes", "one two three four five six seven", "", None, "?!", "one two three four five six seven eight"]
    texts = {
        1: "he was born in paris (France) long ago",
        2: "paris is in france",
        3: "Yes. one two three four five SIX seven; eight",
        4: "one two three four other six seven",
        5: "one two three four five six other eight",
        6: "yesterday",
        7: None,
    }
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_tokens, r.n_equal) for r in decontaminate.leaks(docs, benchmark).collect()}
    # Seven tokens need all of them, eight allow one substitution.
    assert got == {
        (1, 0): (4, 2, 2), (3, 1): (0, 1, 1), (3, 2): (1, 7, 7), (3, 6): (1, 8, 8), (5, 6): (0, 8, 7),
    }
    kept = decontaminate.without_leaks(docs, benchmark).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 6, 7]


def test_rules_are_joined_on_the_prefix_alone(spark, monkeypatch):
    rules = spark.createDataFrame(
        [("a.org", f"/dir/{i}", "block") for i in range(40)] + [("a.org", "/dir/7x", "allow"), ("b.org", "/", "block")],
        "host string, path string, action string",
    )
    pages = spark.createDataFrame([(i, f"http://w.a.org/dir/{i}x") for i in range(50)], "page_id long, url string")

    def verdicts():
        return {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()}

    got = verdicts()
    assert got[7] == ("a.org/dir/7x", "allow") and got[12] == ("a.org/dir/12", "block")
    assert got[45] == ("a.org/dir/4", "block")
    # Every prefix equal: only the digests tell the rules apart; rules lie in many pieces, and nothing is broadcast.
    monkeypatch.setattr(url_filters, "PREFIX_DIGITS", 0)
    monkeypatch.setattr(url_filters, "RULES_TOGETHER", 3)
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    assert verdicts() == got
    plan = url_filters.judge(pages, rules)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("prefix" in line and "digest" not in line for line in joins)
