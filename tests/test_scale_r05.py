"""Findings on the disk of op9 and the memory of op4."""

import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from vulnlake.llm import bm25
from vulnlake.llm import jaccard_join as jj


def test_jaccard_second_comparison_sends_few_shingles(spark, monkeypatch):
    """Near copies of two groups that share many lists but are not similar enough: their shingles are
    not sent to every list they share, and no link is lost."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        words = list(base)
        for k in r.choice(400, 7, replace=False):  # a similarity of about 0.75 between groups
            words[k] = f"g{g}"
        for i in range(4):
            own = list(words)
            own[int(r.integers(400))] = f"x{g}_{i}"
            rows.append((100 * g + i, " ".join(own)))
    kind, sizes = type(spark.range(0)), []
    plain = kind.join

    def join(self, other, *a, **k):
        if "shingles" in other.columns and "component" in self.columns:
            sizes.append(self.count())
        return plain(self, other, *a, **k)
    monkeypatch.setattr(kind, "join", join)
    got = {x["doc_id"]: x["component_id"] for x in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100)).collect()}
    sets = {d: {tuple(t.split()[k:k + 4]) for k in range(397)} for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(8):
        for a in label:
            for b in label:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label and len(set(label.values())) > 6
    assert sizes and sizes[-1] <= 2 * len(rows), sizes


def test_bm25_search_memory_is_bounded_for_short_documents(spark):
    """A shard holds a bounded number of documents, and a group of queries a bounded number of scores."""
    docs = spark.range(0, 200_000, 1, 1).selectExpr("id as doc_id", "concat('w', id % 40, ' v', id % 7, ' x') as text")
    index = bm25.build(docs)
    asked = docs.where("doc_id < 64").withColumnRenamed("doc_id", "query_id")
    terms = {w: xxhash.xxh3_64_intdigest(w.encode()) for r in asked.collect() for w in r["text"].split()}
    signed = {w: h - (1 << 64) if h >> 63 else h for w, h in terms.items()}
    plans = spark.createDataFrame([(r["query_id"], [(signed[w], 1.0 + len(w)) for w in r["text"].split()]) for r in asked.collect()],
                                  "query_id long, words array<struct<term: long, weight: double>>")
    work = []

    class Index:
        sparkSession = spark

        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):
            work.append(f)
            raise InterruptedError
    with pytest.raises(InterruptedError):
        bm25.search_block(Index(), plans, 10, 3.0)
    batches = index.select(*bm25.PARTS).coalesce(1).toArrow().to_batches()
    tracemalloc.start()
    try:
        found = [x for b in work[0](iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6, peak
    got = sorted((q, -s, d) for q, d, s in found if q == 41)[:10]
    assert [d for _, _, d in got] == list(range(41, 200_000, 280))[:10]
