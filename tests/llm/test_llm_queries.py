"""Queries with SQL against DuckDB, the others against brute-force versions, on the smallest tables."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from formwright.llm import check_sql, decontaminate, language, outliers, packing, queries

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = (out + [word], "") if word else (out, word)
        else:
            word += c
    return out + [word] if word else out


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(check_sql.SQL))
def test_sql(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.execute(check_sql.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(map(repr, result.fetchall()))
    assert expected
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, budget=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: float("inf"))
    for i, key in enumerate(ids):
        least[root(i)] = min(least[root(i)], key)
    return {ids[i]: least[root(i)] for i in range(len(ids))}


def test_simhash(spark, sf_dir, docs):
    prints = [brute_fingerprint(t) for _, t, _, _ in docs]
    expected = brute_components([d[0] for d in docs], prints)
    got = {r.doc_id: r for r in queries.op7_simhash(spark, sf_dir).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {d[0]: f"{p:016x}" for d, p in zip(docs, prints)}
    assert {k: r.component_id for k, r in got.items()} == expected


def brute_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return words_of("".join(c if ord(c) >= 128 or c.isalnum() else " " for c in lower))


def brute_leaks(docs, items):
    found = set()
    for item_id, item in items:
        own = brute_tokens(item)
        span = min(len(own), 13)
        if not own:
            continue
        most = span // 5 if len(own) >= 8 else 0  # shorter items stand there unchanged
        for doc_id, text in docs:
            words = brute_tokens(text)
            for i in range(len(words) - span + 1):
                for j in range(len(own) - span + 1):
                    if sum(a == b for a, b in zip(words[i : i + span], own[j : j + span])) >= span - most:
                        found.add((doc_id, item_id))
    return found


def test_decontamination_with_substitutions(spark, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 6").fetchall()
    rng = np.random.default_rng(3)
    rows = [(d[0], " ".join((d[1] or "").split()[:120])) for d in docs[:25]]
    for n, (item_id, text) in enumerate(items):
        words = text.split()
        for change in (0, 4, 5, 6):
            mixed = [f"other{i}" if change and rng.random() < 1 / change else w for i, w in enumerate(words)]
            rows.append((1000 + 10 * n + change, "before it stands this " + " ".join(mixed) + " and that"))
    items.append((90, "one two three four five six seven eight nine"))
    items.append((91, "quite a short item"))
    rows += [(2000, "so One, two three four FIVE six; seven other nine"), (2001, "one two other four five other seven eight nine"),
             (2002, "quite a short item"), (2003, None), (2004, ""), (2005, "quite a shorter item")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert got == brute_leaks(rows, items)
    assert (2000, 90) in got and (2001, 90) not in got and (2002, 91) in got and (2005, 91) not in got
    kept = {r.doc_id for r in decontaminate.without_leaks(d, b).collect()}
    assert kept == {r[0] for r in rows} - {k for k, _ in got}


def test_masks_cover_every_overlap():
    from itertools import combinations

    for n in range(decontaminate.LEAST, decontaminate.SPAN + 1):
        for changed in combinations(range(n), n // 5):
            assert any(
                not set(changed) & {o + j for j in mask}
                for mask in decontaminate.MASKS
                for o in range(n - mask[-1])
            )


def test_decontamination_query_finds_exact_passages(spark, sf_dir, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    exact = {(d[0], i) for d in docs for i, t in items if t in (d[1] or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, sf_dir).collect()}
    assert exact and exact <= got


def check_packing(rows, docs, tokenizer):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key, text, *_ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length])
            assert zlib.crc32(raw) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return len(sequences), sum(r.length for r in rows)


def test_packing(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = queries.op9_packing(spark, sf_dir).collect()
    n, total = check_packing(rows, docs, tokenizer)
    assert n <= total / 2048 * 1.01 + 2
    odd = [
        (1, None, "", ""), (2, "", "", ""), (3, "a <|endoftext|> b", "", ""), (4, "  two  blanks   \x1c é é 👍🏽 don't I'LL\r\n\r\n x", "", ""),
        (5, "lorem ipsum, dolor 123 " * 20000, "", ""), (6, "x" * 5000, "", ""), (7, "กำ 漢字かな 한글 " * 50, "", ""),
    ]
    d = spark.createDataFrame([r[:2] for r in odd], "doc_id long, text string")
    check_packing(packing.pack(d).collect(), odd, tokenizer)


def packed(sizes, capacity=2048, windows=48):
    """Packs documents of these sizes in one task; checks that each id lies in one place, and gives (pieces, padding)."""
    packer = packing.Packer(0, capacity, windows)
    rows = [r for k, n in enumerate(sizes) for r in packer.add(k, np.arange(n, dtype="<u4"))]
    rows += packer.close()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[0]].append((r[1], r[2]))
        sequences[r[5]].append((r[6], r[2]))
    for k, n in enumerate(sizes):
        assert [start for start, _ in sorted(pieces[k])] == [0, *np.cumsum([m for _, m in sorted(pieces[k])])[:-1]]
        assert sum(m for _, m in pieces[k]) == n
    for members in sequences.values():
        members.sort()
        assert [at for at, _ in members] == [0, *np.cumsum([m for _, m in members])[:-1]]
        assert sum(m for _, m in members) <= capacity
    return pieces, 1 - sum(sizes) / max(len(sequences) * capacity, 1)


def test_documents_that_fit_are_seldom_cut(docs):
    rng = np.random.default_rng(3)
    short = rng.integers(1, 1500, 4000)
    sizes = np.where(rng.random(4000) < 0.12, rng.integers(2049, 9000, 4000), short).tolist()
    pieces, padding = packed(sizes)
    fit = [k for k, n in enumerate(sizes) if n <= 2048]
    assert sum(len(pieces[k]) > 1 for k in fit) < 0.05 * len(fit)
    assert padding < 0.01


@pytest.mark.parametrize("capacity", [2, 16, 2048])
def test_packing_of_odd_sizes(capacity):
    rng = np.random.default_rng(4)
    for sizes in ([], [1], [capacity], [capacity + 1] * 7, [1] * 3000, [capacity * 11 // 20 + 1] * 500, rng.integers(1, 3 * capacity, 700).tolist()):
        _, padding = packed(list(sizes), capacity, 12)
        least = -(-sum(sizes) // capacity)
        if capacity > 100 and least:
            assert sum(sizes) / (1 - padding) / capacity <= 1.03 * least + 1


def test_cuts_do_not_change_ids():
    tokenizer = packing.public_tokenizer()
    text = "Some words, 12 numbers 3.5 and\n\nlines  é " * 40
    whole = tokenizer.ids(text)
    parts = packing.cut_at_spaces(text, 100)
    assert len(parts) > 5 and "".join(parts) == text
    assert np.array_equal(np.concatenate([tokenizer.ids(p) for p in parts]), whole)


def test_differencing_divides_evenly():
    rng = np.random.default_rng(1)
    for n, ways in ((1, 1), (1, 4), (6, 4), (40, 5), (300, 24)):
        sizes = rng.integers(1, 200, n).tolist()
        parts = packing.difference(sizes, ways)
        assert sorted(i for p in parts for i in p) == list(range(n)) and len(parts) <= ways
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 5
    # Two-way differencing of a known example: 8, 7, 6, 5, 4 leaves a difference of 2.
    two = [sum((8, 7, 6, 5, 4)[i] for i in p) for p in packing.difference([8, 7, 6, 5, 4], 2)]
    assert sorted(two) == [14, 16]
    # Three numbers of over half a window need a window each: the count rises from 2 to 3.
    assert len(packing.windows_of([60, 60, 60], 100)) == 3


def brute_counts(text):
    words = words_of(text)
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def brute_distances(groups):
    """Scaled squared distances of each row of {(lang, source): vectors}, by the documented method."""
    size, prior, floors = outliers.SIZE, outliers.PRIOR, np.array(outliers.FLOORS)
    groups = {g: np.array(x) for g, x in groups.items()}
    languages = {lang: [g for g in groups if g[0] == lang] for lang, _ in groups}

    def quantile(cells, part):
        return np.sort(cells, axis=0)[int(np.ceil(part * len(cells) - 1e-9)) - 1]

    def drawn(own, n, whole):
        return (own * n + whole * prior) / (n + prior)

    def robust(x):
        low, middle, high = (quantile(np.floor(x * outliers.CELLS), p) for p in (0.25, 0.5, 0.75))
        return (middle + 0.5) / outliers.CELLS, ((high - low) / (outliers.CELLS * 1.349)) ** 2

    def cell(d):
        return np.floor(np.log2(np.maximum(d, 1e-6)) * outliers.DISTANCE_CELLS)

    def distance(x, mean, cov):
        return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)

    def weights(d):
        """One for each of the closest part; equal cells share what is left."""
        c, left, out = cell(d), outliers.SUPPORT * len(d), np.zeros(len(d))
        for value in np.unique(c):
            same = c == value
            out[same] = min(1.0, left / same.sum())
            left -= out[same].sum()
            if left <= 1e-9:
                break
        return out

    def moments(x, w):
        mean = w @ x / w.sum()
        return mean, (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)

    whole = {lang: np.concatenate([groups[g] for g in members]) for lang, members in languages.items()}
    centre = {}
    for g, x in groups.items():
        own, of_all = robust(x), robust(whole[g[0]])
        centre[g] = drawn(own[0], len(x), of_all[0]), drawn(own[1], len(x), of_all[1]) + floors
    now = {(g, 0): (m, np.diag(v)) for g, (m, v) in centre.items()}
    z = {g: (x - centre[g][0]) / np.sqrt(centre[g][1]) for g, x in groups.items()}
    for start, bound in ((1, np.tanh), (2, lambda v: v / np.linalg.norm(v, axis=1)[:, None] * np.sqrt(size))):
        for g, v in z.items():
            y, all_y = bound(v), np.concatenate([bound(z[h]) for h in languages[g[0]]])
            found = drawn(y.T @ y / len(y), len(y), all_y.T @ all_y / len(all_y))
            now[g, start] = centre[g][0], found * np.sqrt(np.outer(centre[g][1], centre[g][1])) + np.diag(floors)
    for step in range(outliers.MOST_STEPS):
        w = {(g, s): weights(distance(groups[g], *now[g, s])) for g, s in now}
        later = {}
        for g, s in now:
            own = moments(groups[g], w[g, s])
            near = np.concatenate([w[h, s] for h in languages[g[0]]])
            of_all = moments(np.concatenate([groups[h] for h in languages[g[0]]]), near)
            n = w[g, s].sum()
            later[g, s] = drawn(own[0], n, of_all[0]), drawn(own[1], n, of_all[1]) + np.diag(floors)
        fall = max(np.linalg.slogdet(now[k][1])[1] - np.linalg.slogdet(later[k][1])[1] for k in now)
        now = later
        if step and fall <= outliers.LEAST_FALL:
            break
    best = {g: min((np.linalg.slogdet(now[g, s][1])[1], s) for s in range(outliers.STARTS))[1] for g in groups}
    d = {g: distance(x, *now[g, best[g]]) for g, x in groups.items()}

    def middle(values):
        return 2 ** ((quantile(cell(values), 0.5) + 0.5) / outliers.DISTANCE_CELLS)

    out = {}
    for g in groups:
        all_d = np.concatenate([d[h] for h in languages[g[0]]])
        k = max(1.0, (1 - np.minimum(floors / np.diag(now[g, best[g]][1]), 1)).sum())
        out[g] = d[g] * k * (1 - 2 / (9 * k)) ** 3 / max(drawn(middle(d[g]), len(d[g]), middle(all_d)), 1e-3)
    return out


def test_outliers(spark, docs):
    rows = [(i, t, "en", f"s{i % 2}") for i, t, _, _ in docs * 4]
    rows += [(9000 + i, "AAAA" * 30 + " " + " ".join(f"W{j}X" for j in range(40)), "en", "s0") for i in range(3)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    rows += [(9900, None, None, None), (9901, "", "en", "s0"), (9902, "a b " * 30, "xx", None), (9903, " ".join(f"v{i}" for i in range(30)), None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(d).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for key, text, lang, source in rows:
        counts = brute_counts(text)
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts
        if not counts[5]:
            words = words_of(text)
            capitals = sum(c.isupper() and c.isalpha() for c in text)
            vector = (
                np.log1p(counts[0]), np.log1p(len(set(words))), np.log(counts[1] / counts[0]), np.sqrt(capitals / counts[1]),
                np.sqrt(counts[2] / counts[1]), np.sqrt(counts[3] / sum(bool(words_of(x)) for x in text.split("\n"))),
                np.sqrt(counts[4] / counts[0]),
            )
            groups[(lang, source)].append((key, vector))
        else:
            assert not r.kept and r.distance2 is None
    expected = brute_distances({g: [v for _, v in members] for g, members in groups.items()})
    for group, members in groups.items():
        np.testing.assert_allclose([got[k].distance2 for k, _ in members], expected[group], rtol=1e-5, atol=1e-7)
        assert [got[k].kept for k, _ in members] == (expected[group] <= outliers.LIMIT).tolist()
    # A capital-heavy text is rejected; a document alone in its language is its own centre.
    assert not got[rows[len(docs) * 4][0]].kept and got[9903].kept and got[9903].distance2 < 1e-6


def brute_languages(pages, model):
    names, k = language.LANGUAGES, len(language.LANGUAGES)
    rows = []
    for page_id, url, html in pages:
        html = (html or "").encode()
        ll = language.TEMPER * (model @ language.trigram_cells(language.visible(html)))
        q = np.exp(ll - ll.max())
        said = language.declared(html)
        host = url.split("://", 1)[1] if url and "://" in url else ""
        for c in "/?#":
            host = host.split(c)[0]
        rows.append((page_id, host.lower(), ll - ll.max(), q / q.sum(), said if said in names else "other" if said else "none"))
    total = sum(r[3] for r in rows)
    crawl = (total + 1) / (total.sum() + k)
    out = {}
    suffixes = {r[1].split(".")[-1] for r in rows}
    for page_id, host, ll, q, said in rows:
        domain, suffix = ".".join(host.split(".")[-2:]), host.split(".")[-1]
        in_host = [r[3] for r in rows if r[1] == host]
        in_domain = [r[3] for r in rows if ".".join(r[1].split(".")[-2:]) == domain]
        in_suffix = sum(r[3] for r in rows if r[1].split(".")[-1] == suffix)
        parent = (sum(in_domain) + language.DOMAIN_WEIGHT * crawl) / (len(in_domain) + language.DOMAIN_WEIGHT)
        prior = (np.maximum(sum(in_host) - q, 0) + language.HOST_WEIGHT * parent) / (len(in_host) - 1 + language.HOST_WEIGHT)
        said_with = sum((r[3] for r in rows if r[4] == said), np.zeros(k))
        score = (
            ll + np.log((said_with + language.OTHER_WEIGHT / (k + 2)) / (total + language.OTHER_WEIGHT))
            + np.log((in_suffix + 1 / len(suffixes)) / (total + 1)) + np.log(prior)
        )
        p = np.exp(score - score.max())
        out[page_id] = (names[int(score.argmax())], p.max() / p.sum())
    return out


def test_language(spark, sf_dir, con, docs):
    pages = con.execute("SELECT page_id, url, html FROM pages").fetchall()
    pages += [(90001, None, None), (90002, "no address", "<html lang=de><p>x</p>"), (90003, pages[0][1], ""), (90004, "http://h.fr", "<html lang='FR-ca'>")]
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = np.full((4, language.CELLS), 0.5)
    for _, text, lang, _ in docs:
        if lang in language.LANGUAGES:
            counts[language.LANGUAGES.index(lang)] += language.trigram_cells((text or "").encode())
    np.testing.assert_allclose(model, np.log(counts / counts.sum(1, keepdims=True)), rtol=1e-12)
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify(d, model).collect()}
    expected = brute_languages(pages, model)
    assert {k: r.lang for k, r in got.items()} == {k: v[0] for k, v in expected.items()}
    for key, r in got.items():
        assert r.probability == pytest.approx(expected[key][1], rel=1e-6)
    right = [got[p].lang in url.split("/") for p, url, _ in pages[:-4]]
    assert np.mean(right) > 0.95


def test_repeats_against_brute_force(spark):
    """Periodic texts, repeats within one document, texts of just a window, copies with edits."""
    from formwright.llm import repeats

    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choice(vocabulary, 300).tolist()
    texts = [
        " ".join(base), " ".join(base[50:200] + ["x"] + base[201:]), " \t".join(base[100:135]), " ".join(base[100:134]),
        " ".join(["a", "b", "c"] * 40), " ".join(["z"] * 35), " ".join(["z"] * 36), " ".join(["y"] * 34),
        " ".join(base[:60] + ["q"] + base[:60]), " ".join(rng.choice(vocabulary, 500)), None, "", "   ",
        " ".join(rng.choice(vocabulary[:3], 400)), " ".join(base), " ".join(f"é{i % 90}" for i in range(200)),
    ]
    for width in (5, 35):
        seen = Counter()
        split = [words_of(t) for t in texts]
        for w in split:
            seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
        d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id: r.intervals for r in repeats.with_intervals(d, width=width).collect()}
        for i, w in enumerate(split):
            covered = {j for a in range(len(w) - width + 1) if seen[tuple(w[a : a + width])] > 1 for j in range(a, a + width)}
            assert {j for p in got[i] for j in range(p["first"], p["end"])} == covered, (width, i)
            assert all(a["end"] < b["first"] for a, b in zip(got[i], got[i][1:]))


def test_kept_digest(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op10_repeats(spark, sf_dir).collect()}
    untouched = [d for d in docs if got[d[0]].n_removed == 0]
    assert untouched
    for key, text, *_ in untouched:
        assert got[key].kept_sha256 == hashlib.sha256(" ".join(words_of(text)).encode()).hexdigest()
