import random
import re

import cases
from quire.llm import near_dedup


def shingles(t, k):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def roots(rows, k, t=0.8):
    """(shingles, component) of each row by comparing all pairs; components are numbers of rows."""
    sets, parent = [shingles(x, k) for _, x, *_ in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= round(100 * t) * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def brute(rows, k, t=0.8):
    """(id, shingles, least id of the component) of each row."""
    found, least = roots(rows, k, t), {}
    for (d, *_), (_, r) in zip(rows, found, strict=True):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    return sorted((str(d), n, str(None if least[r][0] else least[r][1])) for (d, *_), (n, r) in zip(rows, found, strict=True))


def got(df, k, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_groups(df, words=k, **options).collect())


def test_cases(spark):
    for k in (2, 5):
        assert got(cases.documents(spark), k) == brute(cases.ROWS, k)
    assert near_dedup.near_groups(cases.empty(spark)).count() == 0
    kept = near_dedup.near_representatives(cases.documents(spark), words=5)
    assert kept.columns == cases.documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "None", "8", "9", "10", "11", "12", "13", "13"])
    again = near_dedup.near_representatives(cases.documents(spark).repartition(5), words=5)
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


def test_chains_and_hot_groups(spark):
    """Groups of copies edited more and more, frequent words and unrelated texts."""
    rnd, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(4000)]
    for g in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((6, 25, 60, 200)))]
        for c in range(25):
            t = list(base)
            for _ in range(int(len(t) * rnd.choice((0, 0.01, 0.04, 0.08, 0.12)))):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(t), "en", "s", 1))
    for _ in range(60):
        rows.append((len(rows), " ".join(["the", "of"] * 5 + [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40))]), "en", "s", 1))
    rnd.shuffle(rows)
    for chunk in (256, 4):
        assert got(cases.documents(spark, rows), 2, chunk=chunk) == brute(rows, 2)


def test_null_ids_and_rows_without_words(spark):
    rows = [(None, cases.words(40, i % 3), "en", "s", 1) for i in range(9)] + [(None, "", "en", "s", 1)] * 3 + [(4, None, "en", "s", 1)] * 2
    assert got(cases.documents(spark, rows), 2) == brute(rows, 2)
    assert near_dedup.near_representatives(cases.documents(spark, rows)).count() == 3 + 3 + 2


def test_rows_that_differ_in_one_column(spark):
    """The least row key decides, in whatever order the rows come."""
    rows = [(1, cases.words(40), lang, "s", 1) for lang in ("en", "fr", "de")]
    left = {tuple(near_dedup.near_representatives(cases.documents(spark, r).coalesce(1)).collect()) for r in (rows, rows[::-1])}
    assert len(left) == 1 and len(next(iter(left))) == 1


def test_bounds():
    assert near_dedup.least_shared(64, 0.8, 1e-7) == 33
    assert near_dedup.least_shared(10, 0.8, 0.0) == 1
