"""The Merkle manifest against a plain version that builds each tree as nested lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from formwright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, i int, node string, root string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(row, place):
    """(root, siblings with their places) of one row of digests."""
    path = []
    while len(row) > 1:
        pair = row[place - place % 2 : place - place % 2 + 2]
        path.append((place % 2, len(pair), [x for j, x in enumerate(pair) if j != place % 2]))
        row = [digest("".join(row[k : k + 2])) for k in range(0, len(row), 2)]
        place //= 2
    return row[0], path


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        tops[g] = climb([plain_leaf(r) for r in groups[g]], 0)[0]
    out = []
    for k, g in enumerate(order):
        bottom = [plain_leaf(r) for r in groups[g]]
        root, above = climb([tops[x] for x in order], k)
        for place, row in enumerate(groups[g]):
            path = climb(bottom, place)[1] + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            fold = plain_leaf(row, 1) if tampered else bottom[place]
            for side, _, others in path:
                fold = digest("".join([*others, fold] if side else [fold, *others]))
            proof = digest("".join(x for _, _, others in path for x in others))
            out.append((row[0], bottom[place], tops[g], root, proof, fold, fold == root))
    return sorted(map(repr, out))


def run(df, height):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    other = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.proofs(df, changed={"n_chars": other}, height=height)


def rows_of(n, lang):
    return [(k * 3 % 1009, f"s{k % 3}", lang, k if k % 5 else None, f"texté {k}", "g", 1, "n", "r") for k in range(n)]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_against_plain_trees(spark, height):
    odd = [(None, None, None, None, None, "g", 1, "n", "r"), (5, "", "de", 0, "", "g", 1, "n", "r"), (5, "", "de", 0, "", "g", 1, "n", "r"),
           (6, "x", "", 9, "y" * 100_000, "g", 1, "n", "r"), (-7, "x", "zh", 9, None, "g", 1, "n", "r")]
    rows = odd + rows_of(70, "en") + rows_of(9, None) + rows_of(33, "fr")
    df = spark.createDataFrame(rows, SCHEMA)
    found = run(df, height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = found.collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_small_tables(spark):
    df = spark.createDataFrame(rows_of(1, "en"), SCHEMA)
    only = run(df, 10).collect()
    assert [tuple(r) for r in only] and only[0].leaf == only[0].subroot == only[0].root
    assert only[0].proof_sha256 == digest("")
    assert run(df.limit(0), 10).count() == 0


@pytest.mark.parametrize("levels", range(1, 12))
def test_layout_is_a_permutation_with_whole_subtrees(levels):
    rows = merkle.addresses(levels)
    assert sorted(x for row in rows for x in row.tolist()) == list(range((1 << levels) - 1))
    upper = levels // 2
    if upper:
        # The upper half comes first, then each lower subtree as one run.
        assert sorted(x for row in rows[:upper] for x in row.tolist()) == list(range((1 << upper) - 1))
        below = [x for row in rows[upper:] for x in row[: len(row) >> upper].tolist()]
        assert sorted(below) == list(range((1 << upper) - 1, (1 << upper) - 1 + (1 << (levels - upper)) - 1))
