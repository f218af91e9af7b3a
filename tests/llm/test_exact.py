"""Results that do not depend on the size of a length or of the benchmark."""

import hashlib

import pytest

pytest.importorskip("terravane.llm.queries")

from terravane.llm import decontaminate, packing


@pytest.mark.parametrize("lengths, buckets, each", [([1001] * 7, 16, {1001: 65}), ([21_845] * 7, 16, {21_845: 3}), ([1001] * 3 + [1002] * 4, 2, {1001: 65, 1002: 65}), ([5, 30_001, 30_002, 30_003], 4, {5: 13107, 30_001: 2, 30_002: 2, 30_003: 2})])
def test_boundaries_are_lengths_that_occur(spark, lengths, buckets, each):
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    out = packing.pack(rows, buckets).collect()
    assert len(out) == len(lengths) and all(r.padding == 0 and r.boundary == r.n_tokens for r in out)
    for length, most in each.items():
        own = sorted((r.batch, r.slot) for r in out if r.n_tokens == length)
        assert own == [(k // most, k % most) for k in range(len(own))]


def test_items_with_newlines_in_blocks(spark):
    items = [("a\nb", "one two three"), ("c", "four five six"), ("\n", "seven eight nine"), ("", "ten eleven twelve")]
    text = " ".join(t for _, t in items)
    docs = spark.createDataFrame([(1, text), (2, "four five six"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    digest = lambda *ids: hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    want = [(1, 12, 4, digest(*[i for i, _ in items])), (2, 3, 1, digest("c")), (3, 0, 0, digest())]
    for block in (1 << 24, 10):
        got = decontaminate.find_contamination(docs, bench, block=block).collect()
        assert sorted((r.doc_id, r.n_hit, r.n_items, r.items_sha256) for r in got) == want, block
