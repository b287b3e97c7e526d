"""Findings on the cost of the training-data operators."""

import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import xxhash

from vulnlake.llm import bm25, bpe, packing, queries
from vulnlake.llm import jaccard_join as jj


def test_bm25_group_scores_frequent_lists_at_once(monkeypatch):
    """Long queries in groups: the same results, and few of the postings are gathered list by list."""
    r = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(5000)])
    chance = 1 / np.arange(1, 5001)
    texts = [" ".join(r.choice(words, n, p=chance / chance.sum())) for n in r.integers(0, 300, 1500)]
    texts += texts[:40] + [""]
    row = bm25.invert([(i, t.encode()) for i, t in enumerate(texts)])
    plain, grouped = (bm25.Shard(row, row["total"] / row["n"], most) for most in (0, 200))
    assert 0 < len(grouped.matrix) <= 200 and not len(plain.matrix)
    asked = []
    for t in [*texts[:100], "unknown words", "w0", ""]:
        own, times = np.unique(np.array(t.split(), str), return_counts=True)
        asked.append((np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in own], np.uint64), times * r.uniform(0.5, 5, len(own))))
    gathered, spans = [], bm25.spans
    monkeypatch.setattr(bm25, "spans", lambda start, at: gathered.append(int((start[at + 1] - start[at]).sum())) or spans(start, at))
    want = [plain.top(q, 7) for q in asked]
    before, gathered[:] = sum(gathered), []
    got = grouped.tops(asked, 7, [-1.0] * len(asked))
    assert 4 * sum(gathered) < before
    assert [[d for d, _ in g] for g in got] == [[d for d, _ in w] for w in want]
    assert all(np.allclose([s for _, s in g], [s for _, s in w]) for g, w in zip(got, want, strict=True))
    assert got[-3] == [] and got[-1] == [] and len(got[-2]) == 7
    least = [w[2][1] if len(w) > 2 else -1.0 for w in want]
    assert [g[:3] for g in grouped.tops(asked, 7, least)] == [g[:3] for g in got]
    empty = bm25.invert([])
    assert bm25.Shard(empty, 0.0, 200).tops(asked[:2], 7, [-1.0, -1.0]) == [[], []]


def test_bm25_many_queries_equal_single_ones(spark, monkeypatch):
    r = np.random.default_rng(7)
    rows = [(i, " ".join(r.choice([f"w{j}" for j in range(60)], 20))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.withColumnRenamed("doc_id", "query_id")
    index = bm25.build(docs)
    got = sorted(map(tuple, bm25.search(index, asked, 5).collect()))
    monkeypatch.setattr(bm25, "MOST_FREQUENT", 0)
    want = sorted(map(tuple, bm25.search(index, asked, 5).collect()))
    assert len(got) == 750 and [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


def test_jaccard_mixed_lists_send_few_shingles():
    """Bitmaps with known components: only classes with a possible partner in another component stay, and no
    similar pair of two components is lost."""
    r = np.random.default_rng(8)
    sets, known = [], []
    for g in range(30):
        base = np.unique(r.integers(0, 2**63, 120).astype(np.uint64))
        for _ in range(5):  # near copies, connected already
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) > 0.03], r.integers(0, 2**63, 2).astype(np.uint64)])))
            known.append(g)
    known = np.array(known)
    known[7], known[52] = 100, 101  # two classes whose links are not known yet
    maps, size = [jj.bitmap(s, jj.width_of(len(s))).tobytes() for s in sets], np.array([len(s) for s in sets])
    least = Fraction(17, 20)
    plain, pruned = jj.candidates(maps, size, least), jj.candidates(maps, size, least, None, known)
    similar = {i for i in range(len(sets)) for j in range(len(sets)) if known[i] != known[j] and jj.similar(sets[i], sets[j], least)}
    assert 7 in similar and 52 in similar and similar <= set(np.flatnonzero(pruned).tolist())
    assert plain.sum() > 100 and pruned.sum() < 30
    side = np.arange(len(sets)) % 2
    across = {i for i in similar if any(side[i] != side[j] and known[i] != known[j] and jj.similar(sets[i], sets[j], least) for j in range(len(sets)))}
    assert across <= set(np.flatnonzero(jj.candidates(maps, size, least, side, known)).tolist())


def test_jaccard_sketch_counts_sets(spark):
    """The sketch's cells stay within 16 MB, are sent compressed, and count each text once a shingle."""
    assert jj.MOST_CELLS <= 1 << 24
    texts = ["a b c d e f", "A b  c d e f", "a b c d x", "a b c d a b c d", "", "a b"]
    docs = spark.createDataFrame([(bytes(t, "utf8"),) for t in texts], "text binary").coalesce(1)
    level, want = jj.sketch(docs, 4), np.zeros(jj.LEAST_CELLS, np.int64)
    for i, (_, s) in enumerate(jj.shingle_sets(iter([(t.encode(),) for t in texts]), 4)):
        if i != 1:  # a copy
            want[np.unique(jj.cells_of(s, len(want)))] += 1
    assert (level == np.round(4 * np.log2(want + 1))).all()
    values = np.array([5, 1, 5, 9, 1], np.uint64)
    assert jj.distinct(values).tolist() == [1, 5, 9] and jj.distinct(values[:0]).tolist() == []


def test_line_dedup_query_makes_page_texts_once(spark, tmp_path):
    """op1 counts lines in, and cuts them from, one staged text: the markup is taken out once."""
    rows = [(i, f"https://H{i % 2}.net/{i}", f"<html><p>menu</p><p>page {i}</p></html>") for i in range(40)] + [(40, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.QUERIES["op1_line_dedup"](spark, str(tmp_path))
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == 41 and (got[3]["n_lines"], got[3]["n_dropped"], got[3]["text"]) == (4, 1, "\npage 3\n")
    assert got[40]["text"] is None and got[40]["n_lines"] == 0
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_packing_words_of_latin_texts():
    """Words of letters are tried first, with the same words as the library's pattern, and ASCII words need no table."""
    assert bpe.LATIN.pattern.startswith(f" ?[{bpe.LETTERS}]++|")
    r, some = random.Random(3), ["a", "B", " ", " ", "\n", "\t", ".", "'", "'s", "'ll", "1", "\xa0", "\x85", "\r", "\x1c", "\x0b", "é", "²", "n't", "  ", "-"]
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    encode.letters = {}  # only words beyond ASCII, or with control characters, are translated
    for _ in range(3000):
        text = "".join(r.choices(some, k=r.randrange(12)))
        assert bpe.LATIN.findall(text) == bpe.ANY.findall(text), text
        if text.isascii() and text.isprintable():
            assert encode(text) == encode.packed(encode.tokenizer.encode(text, add_special_tokens=False).ids)
