"""Near copies by five-word shingles against a brute-force version."""

import random

import duckdb
from test_llm_queries import words_of

import corpus_pipeline


def brute_kept(docs):
    """The smallest id of each component of texts that are similar by at least 0.8."""
    sets = []
    for _, text in docs:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted(least.values())


def kept(spark, sf_dir, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, d, sf_dir).collect())


def test_given_documents(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert kept(spark, sf_dir, docs) == brute_kept(docs)


def test_near_copies_chains_and_groups(spark, sf_dir):
    rng = random.Random(3)
    docs = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "one two three")]

    def add(words):
        docs.append((len(docs) + 1, " ".join(words)))
        return words

    for n in (30, 60, 200, 900):
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        # A group around one text whose members differ more from each other than from it ...
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(n), max(1, n // 60)):
                copy[at] = f"v{rng.randrange(10**9)}"
            add(copy)
        add(base)
        # ... and a chain whose ends share little.
        for step in range(15):
            base = add(base[max(2, n // 20) :] + [f"c{step}x{i}" for i in range(max(2, n // 20))])
    rng.shuffle(docs)
    expected = brute_kept(docs)
    assert 10 < len(expected) < len(docs) - 60
    assert kept(spark, sf_dir, docs) == expected
