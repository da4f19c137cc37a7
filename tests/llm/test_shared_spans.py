import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from docveil.llm import shared_spans as S
from docveil.llm.window_hash import WindowHash

SCHEMA = "doc_id long, text string, keys string, b int"


def brute(rows, n=200):
    where = defaultdict(set)
    for doc, text in rows:
        for k in range(len(text or "") - n + 1):
            where[text[k : k + n]].add(doc)
    pairs = set()
    for docs in where.values():
        pairs.update(itertools.combinations(sorted(docs), 2))
    covered = {}
    for doc, text in rows:
        marks = set()
        for k in range(len(text or "") - n + 1):
            if len(where[text[k : k + n]]) > 1:
                marks.update(range(k, k + n))
        covered[doc] = len(marks)
    return pairs, covered


@pytest.mark.parametrize("period", list(S.COVERS))
def test_covers_are_perfect(period):
    cover = S.COVERS[period]
    assert sorted((a - b) % period for a in cover for b in cover if a != b) == list(range(1, period))


def test_window_hash():
    cp = np.random.default_rng(1).integers(0, 0x10FFFF, 500).astype(np.uint32)
    cp[300:400] = cp[100:200]
    h = WindowHash(cp)
    one = h.at(np.arange(400), 100)
    assert one[100] == one[300] and len(set(one.tolist())) == 399
    assert h.at(np.array([100]), 100)[0] == WindowHash(cp[100:200]).at(np.array([0]), 100)[0]


def corpus():
    rng = random.Random(2)
    letters = "abcdefgh éß語😀\n"
    new = lambda n: "".join(rng.choice(letters) for _ in range(n))
    part, exact, short = new(450), new(200), new(199)
    rows = [(i, new(rng.randint(0, 500))) for i in range(1, 30)]
    rows += [(100 + i, new(rng.randint(0, 300)) + part + new(rng.randint(0, 300))) for i in range(5)]
    rows += [(200, new(37) + exact), (201, exact + new(90)), (202, new(5) + short), (203, short + new(7)), (300, None), (301, ""), (302, "   "), (303, part), (304, part), (305, "x" * 700), (306, "x" * 200), (307, "x" * 199)]
    rows += [(400, part[:300] + new(50)), (401, new(3) + part[150:]), (-5, exact), (2**40, exact)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def test_pairs_and_report_match_brute_force(spark):
    rows = corpus()
    df = frame(spark, rows).unionByName(frame(spark, rows[:40]))  # repeated rows count once
    pairs, covered = brute(rows)
    got = [tuple(r) for r in S.shared_pairs(df).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    report = {r.doc_id: r for r in S.shared_report(df).collect()}
    assert {k: r.shared_chars for k, r in report.items()} == covered
    assert report[303].shared_part == 1.0 and report[300].n_chars == 0 and report[300].shared_part == 0.0


def test_hot_passage_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIR_BLOCK", 4)
    rng = random.Random(4)
    hot = "".join(rng.choice("abcdef") for _ in range(260))
    rows = [(i, str(i) * rng.randint(1, 20) + hot) for i in range(25)]
    got = {tuple(r) for r in S.shared_pairs(frame(spark, rows)).collect()}
    assert got == set(itertools.combinations(range(25), 2))


def test_empty_table(spark):
    assert S.shared_pairs(frame(spark, [])).count() == 0 and S.shared_report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 20, 50, 120])
def test_other_lengths(spark, n):
    rng = random.Random(n)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 2 * n)))) for i in range(12)]
    pairs, _ = brute(rows, n)
    assert {tuple(r) for r in S.shared_pairs(frame(spark, rows), min_chars=n).collect()} == pairs


def test_hot_passage_over_many_tasks(spark):
    """Tasks that see a passage in several documents send two entries of it, others one; classes tell the same as pairs."""
    rng = random.Random(5)
    hot = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 60))) + hot) for i in range(60)] + [(1000, hot), (1001, "q" * 150)]
    df = frame(spark, rows).repartition(7)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == set(itertools.combinations([*range(60), 1000], 2))
    members = S.shared_classes(df).collect()
    assert {r.doc_id for r in members if r.representative == 0 and r.n_members == 61} == {*range(60), 1000}
