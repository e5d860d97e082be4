import random
from collections import defaultdict

import pytest

from loomstack.llm import packing as P


def bins_of(runs):
    used = defaultdict(int)
    ranks = defaultdict(set)
    for length, start, n, each, first in runs:
        for r in range(n * each):
            assert start + r not in ranks[length]
            ranks[length].add(start + r)
            used[first + r // each] += length
    return used, ranks


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_item_once_within_capacity(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 7, 64, 256])
    h = {rng.randint(1, cap): rng.randint(1, 300) for _ in range(rng.randint(1, 40))}
    used, ranks = bins_of(P.plan(h, cap))
    assert {k: len(v) for k, v in ranks.items()} == h and all(ranks[k] == set(range(n)) for k, n in h.items())
    assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
    # Best fit decreasing stays within 11/9 of the optimum, whose lower bound is the volume.
    volume = sum(k * n for k, n in h.items())
    big = sum(n for k, n in h.items() if 2 * k > cap)
    assert len(used) <= 11 / 9 * max(-(-volume // cap), big) + 4 or len(used) <= big + -(-2 * volume // cap)


def test_plan_is_small_for_many_items():
    runs = P.plan({k: 10_000_000_000 // k for k in range(1, 257)}, 256)
    assert len(runs) < 40_000


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_large_capacities_are_planned_in_steps(spark, monkeypatch, sent):
    """Any capacity and any number of kinds: with few cells a plan is rougher, but whole and within the capacity."""
    monkeypatch.setattr(P, "CELLS", 10)
    monkeypatch.setattr(P, "SENT_RUNS", sent)
    d = spark.createDataFrame([(i, "word " * (i * 7 % 83)) for i in range(150)], "doc_id long, text string")
    c = spark.createDataFrame([(f"k{n}", "byte_bpe_50k", n) for n in (1, 9, 10, 11, 64, 97)], "container string, tokenizer string, capacity long")
    size = dict(zip(range(150), P.counter("byte_bpe_50k", *P.tokenizer_file("byte_bpe_50k"))(["word " * (i * 7 % 83) for i in range(150)])))
    rows = P.packed(d, c).collect()
    for cap in (1, 9, 10, 11, 64, 97):
        mine = [r for r in rows if r.container == f"k{cap}"]
        total, used = defaultdict(int), defaultdict(int)
        for r in mine:
            total[r.doc_id] += r.size
            if r.bin is not None:
                used[r.bin] += r.size
        assert dict(total) == size and max(used.values()) <= cap and sorted(used) == list(range(len(used)))
        assert sum(used.values()) >= 0.6 * cap * len(used)


def test_documents_take_slots(spark):
    docs = [(i, "word " * (i % 60)) for i in range(200)] + [(900, None), (901, ""), (902, "long text " * 3000), (903, "tie"), (904, "tie")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as size", "2 as bin", "3 as container")
    c = spark.createDataFrame([("s", "byte_bpe_50k", 64), ("w", "word_bpe_49k", 100), ("p", "piece_bpe_32k", 128), ("bad", "byte_bpe_50k", 0), ("null", "byte_bpe_50k", None)], "container string, tokenizer string, capacity long")
    rows = P.packed(d, c).collect()
    for name, tok, cap in (("s", "byte_bpe_50k", 64), ("w", "word_bpe_49k", 100), ("p", "piece_bpe_32k", 128)):
        size = dict(zip((i for i, _ in docs), P.counter(tok, *P.tokenizer_file(tok))([t for _, t in docs])))
        mine = [r for r in rows if r.container == name]
        total, used = defaultdict(int), defaultdict(int)
        for r in mine:
            total[r.doc_id] += r.size
            if r.bin is not None:
                used[r.bin] += r.size
        assert dict(total) == size and max(used.values()) <= cap
        pieces = defaultdict(int)
        for r in mine:
            pieces[r.doc_id] += 1
        assert all(pieces[i] == max(1, -(-n // cap)) for i, n in size.items())  # split only what is too long, as little as possible
        assert {r.doc_id for r in mine if r.bin is None} == {i for i, n in size.items() if n == 0}
        assert len(used) <= sum(used.values()) / cap * 1.1 + 2
    assert {r.container for r in rows} == {"s", "w", "p"}
    assert P.packed(d.where("false"), c).count() == 0 and P.packed(d, c.where("false")).count() == 0
