import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

import cases
from quire.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, texts=False):
    owners = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    place = lambda i: 2**63 - 1 if i is None else i
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)].add(place(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == place(i)]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), *([text] if texts else [])))
    return out


def got(df):
    done = line_dedup.dedup_lines(df, batches=3, fanout=2)
    return [(r.doc_id, r[-1].before, r[-1].dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in done.collect()]


def test_cases(spark):
    assert sorted(map(str, got(cases.documents(spark)))) == sorted(map(str, brute(cases.ROWS)))
    assert got(cases.empty(spark)) == []
    done = line_dedup.dedup_lines(cases.documents(spark))
    assert done.columns == [*cases.documents(spark).columns, "lines_"] and {r.lines for r in done.collect()} == {"l"}


def test_equal_rows_are_counted_alone(spark):
    rows = [(1, "one line that both have", "en", "s", 1), (2, "one line that both have\nmore", "en", "s", 1), (2, "one line that both have\nmore", "en", "s", 1)]
    assert sorted((i, n, d) for i, n, d, _ in got(cases.documents(spark, rows))) == [(1, 1, 0), (2, 2, 1), (2, 2, 1)]


def test_nothing_is_left_behind(spark, monkeypatch):
    """Not even after a failure: neither tables nor folders."""
    from quire.llm import common

    root = common.shared_root(spark).removeprefix("file://")
    before = {p.name for p in Path(root, "quire").glob("*")}
    monkeypatch.setattr(line_dedup.LineRuns, "compact", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup_lines(cases.documents(spark))
    left = {p.name for p in Path(root, "quire").glob("*")} - before
    assert all(n.startswith("lines-result-") for n in left)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quire_lines_")]

def test_any_number_of_batches(spark):
    rows = [(i, "\n".join(f"shared line number {j}" for j in range(i % 7)) + f"\n  UNIQUE line of {i}\nshort\nthe same in every doc", "en", "s", 1) for i in range(60)]
    expected = sorted(map(str, brute(rows)))
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        df = line_dedup.dedup_lines(cases.documents(spark, rows), batches=batches, fanout=fanout)
        assert sorted(str((r.doc_id, r[-1].before, r[-1].dropped, hashlib.sha256(r.text.encode()).hexdigest())) for r in df.collect()) == expected
