import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as P


def fills(classes):
    return [sum(k * v for k, v in c.items()) for m, c in classes for _ in range(m)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=25))
def test_plan_places_every_length_once(histogram):
    first = P.best_fit(histogram, 50)
    last = P.local_search(first, 50)
    for classes in (first, last):
        held = Counter()
        for m, c in classes:
            for k, v in c.items():
                held[k] += m * v
        assert held == Counter(histogram) and max(fills(classes)) <= 50
    assert len(fills(last)) <= len(fills(first))
    assert len(fills(last)) == len(fills(first)) or sum(x * x for x in fills(last)) >= sum(x * x for x in fills(first))


def test_local_search_empties_bins():
    # best fit leaves 4 bins (6+3, 6+3, 4+4, 2): exchanges reach 3
    classes = [(2, Counter({6: 1, 3: 1})), (1, Counter({4: 2})), (1, Counter({2: 1}))]
    assert len(fills(P.local_search(classes, 10))) == 3


def test_cuts():
    assert P.cuts(1) == [(0, 1)] and P.cuts(2048) == [(0, 2048)]
    assert P.cuts(5000) == [(0, 904), (904, 2952), (2952, 5000)]


def test_long_runs_of_white_space():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 2_000_000
    runs = [" " * n, "\n" * n, "\t" * n, " \n\u3000\t\x85" * (n // 5)]
    texts = [runs[0], runs[1], "a" + runs[0] + "b", "a." + runs[1] + "b", runs[2] + "7", "x" + runs[3] + "-", runs[3] + "<|endoftext|>" + runs[0] + "y<|endoftext|>", "a\x1c" * 20_000 + " " * 9_999 + "b" + " " * 10_000 + "é"]
    for text in texts:
        assert P.encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_whole(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "a", "<|endoftext|> x", "Ünïcödé  \n\n it's 12,5 €", "z" * 30_000, "the same"] + ["the same"] * 5
    texts += [" " * 1_200_000 + "x", "\n\t" * 600_000]
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 99, n)) for n in rng.integers(1, 3000, 60)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "no id", 1), (3, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = P.pack(docs, with_ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (s, e) in enumerate(P.cuts(len(ids))):
            want[(d, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for x in by.values():
        x.sort()
        assert [a for a, _, _ in x] == [0, *np.cumsum([n for _, n, _ in x])[:-1]] and sum(n for _, n, _ in x) <= P.SEQUENCE
    packed = P.pack(docs, with_ids=True)
    assert {r.sequence_id: list(r.ids) for r in P.sequences(packed).collect()} == {k: [i for _, _, ids in x for i in ids] for k, x in by.items()}
    assert P.pack(docs.where("false")).collect() == []


def exchanges(donor, taker, size):
    """Whether moving, or exchanging one or two documents for one, fills the taker more."""
    a, room = list(donor.elements()), size - sum(taker.elements())
    gets = [x for i, x in enumerate(a)] + [x + y for i, x in enumerate(a) for y in a[:i]]
    return any(0 < got - gives <= room for got in gets for gives in (0, *taker))


def test_search_improves_and_ends_where_nothing_helps():
    rng = np.random.default_rng(0)
    fewer = 0
    for _ in range(12):
        h = {int(x): int(rng.integers(1, 30)) for x in rng.choice(np.arange(20, 60), 25, replace=False)}
        first, last = P.best_fit(h, 100), P.local_search(P.best_fit(h, 100), 100)
        n, m = len(fills(first)), len(fills(last))
        bound = -(-sum(fills(first)) // 100)
        assert bound <= m <= n
        fewer += m < n
        if m > bound:
            for i, (k, c) in enumerate(last):
                for j, (_, d) in enumerate(last):
                    if sum(c.elements()) <= sum(d.elements()) < 100 and (i != j or k > 1):
                        assert not exchanges(c, d, 100)
    assert fewer >= 8
