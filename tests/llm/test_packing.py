import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packrel.llm import packing


def check_plan(histogram, capacity, segments, bins):
    seen, use = set(), defaultdict(list)
    for x, a, n, s, o in segments:
        for i in range(n):
            assert (x, a + i) not in seen
            seen.add((x, a + i))
            use[s + i].append((o, x))
    assert Counter(x for x, _ in seen) == {x: n for x, n in histogram.items() if n}
    assert sorted(use) == list(range(bins))
    for own in use.values():
        at = 0
        for o, x in sorted(own):
            assert o == at
            at += x
        assert at <= capacity


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plans_hold_everything(histogram):
    check_plan(histogram, 64, *packing.plan(histogram, 64, groups=6))


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.3, 1.1, 20_000).astype(int), 1, 2047)
    histogram = Counter(lengths.tolist())
    segments, bins = packing.plan(histogram)
    check_plan(histogram, 2048, segments, bins)
    assert bins <= 1.01 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_cuts(n):
    pieces = packing.cut(n, 2048)
    assert sum(k for _, k in pieces) == n and all(k == 2048 for _, k in pieces[1:]) and [s for s, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1]]


def test_round_trip(spark, odd, odd_rows):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], zlib.crc32(np.array([*slow.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in odd_rows if len(r[1] or "") < 5000)
    got = [r.asDict() for r in packing.pack(odd, with_ids=True).collect()]
    whole = Counter((r["doc_id"], r["ids_crc32"]) for r in got if r["doc_id"] != 5)
    assert whole == want
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    long = sorted((r["piece"], r["start"], r["ids"]) for r in got if r["doc_id"] == 5)
    assert sum((x for *_, x in long), []) == [*slow.encode(next(r[1] for r in odd_rows if r[0] == 5), add_special_tokens=False).ids, 0]
    use = defaultdict(list)
    for r in got:
        use[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in use.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048


def test_empty(none):
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 200_000, "a b " * 2000 + " \t" * 3000, "x<|endoftext|>y", "é" * 1500 + " 中文", "\u3000" * 1200])
def test_ids_are_the_json_tokenizers(text):
    """Long runs and the special token too."""
    json = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), json)
    assert list(encode(text)) == Tokenizer.from_file(json).encode(text, add_special_tokens=False).ids


def test_a_row_repeated_very_often_fills_all_lanes(spark):
    df = spark.createDataFrame([(1, "same words")] * 3000, "doc_id long, text string").repartition(3)
    got = packing.pack(df, 64).collect()
    assert len(got) == 3000 and len({(r.sequence_id, r.offset) for r in got}) == 3000
