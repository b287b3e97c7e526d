"""Operators of vulnlake.llm against brute force, round trips and held-out labels, on small tables with
nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vulnlake.llm import bm25, decontaminate, fm_index, jaccard_join, langid, line_dedup, lm_score, packing, quality, toxicity, url_filter
from vulnlake.llm.common import held_out

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, row long, n long"


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["Der", "été", "niño"]
    rows = []
    for i in range(60):
        t = "\n".join(" ".join(r.choice(words, 9)) for _ in range(int(r.integers(1, 6))))
        rows.append((i, t + ("\ncommon line here" if i % 2 else ""), ["en", "de"][i % 2], f"s{i % 3 % 2}", len(t), 0.5, "h", i, i))
    rows += [(60, rows[0][1], "en", "s0", 1, 0.5, "h", 1, 1), (61, rows[0][1] + " tail", "en", "s0", 1, 0.5, "h", 1, 1), (60, rows[0][1], "en", "s0", 1, 0.5, "h", 1, 1),
             (62, None, None, None, None, None, None, None, None), (63, "", "en", "s1", 0, 0.0, "", 0, 0), (None, "w1 w2", None, None, 3, 0.0, "", 0, 0),
             (64, "...!?", "en", "s1", 0, 0.0, "", 0, 0), (65, "ab " * 30_000 + "z" * 5_000, "en", "s1", 0, 0.0, "", 0, 0), (66, "two words", "en", "s1", 0, 0.0, "", 0, 0),
             (67, "日本語 <|endoftext|> x y", "en", None, 0, 0.0, "", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def tuples(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_line_dedup_brute_force(docs):
    got = line_dedup.line_dedup(docs, "source", "text", 0.3, 3).collect()
    rows = docs.collect()
    pages, seen = Counter(r["source"] or "" for r in rows), Counter()
    for r in rows:
        seen.update({(r["source"] or "", x.strip(" ")) for x in (r["text"] or "").split("\n") if x.strip(" ")})
    want = []
    for r in rows:
        s, lines = r["source"] or "", None if r["text"] is None else r["text"].split("\n")
        kept = lines and [x for x in lines if not (seen[s, x.strip(" ")] >= 3 and seen[s, x.strip(" ")] > 0.3 * pages[s] and x.strip(" "))]
        want.append((r["doc_id"], lines and "\n".join(kept), len(lines or ()), len(lines or ()) - len(kept or ())))
    key = lambda t: (t[0] is None, t)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got), key=lambda t: str(key(t))) == sorted(want, key=lambda t: str(key(t)))
    assert any(r["n_dropped"] for r in got)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    clash = docs.withColumns({"_site": F.lit(1), "_BAD": F.lit(2), "_kept": F.lit(3), "_text": F.lit(4), "a.b": F.lit(5)})
    more = line_dedup.line_dedup(clash, "source", "text", 0.3, 3)
    assert set(clash.columns) < set(more.columns)
    assert more.where("_site = 1 and _BAD = 2 and _kept = 3 and _text = 4 and `a.b` = 5").count() == len(want)
    assert {(r["doc_id"], r["text"]) for r in more.collect()} == {(w[0], w[1]) for w in want}


def test_url_filter_rules_and_model(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de/", "http://x.example.com/de/1#f", "http://example.org/fr/", "http://example.org/en/",
            "http://net", "nourl", None, "", "http://free-bets.example.org/en/5", "http://h/p?://k/", "https://notexample.com/de/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, host string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    out = {r["page_id"]: r for r in url_filter.url_filter(pages, url_filter.labelled_urls(spark), rules).collect()}
    assert [out[i]["host"] for i in range(len(urls))] == ["a.example.net", "example.net", "x.example.com", "example.org", "example.org", "net", "", "", "",
                                                          "free-bets.example.org", "h", "notexample.com"]
    assert [out[i]["path"] for i in (0, 2, 5, 10)] == ["/en/x", "/de/1", "", "/p"]
    assert [out[i]["rule"] for i in (0, 1, 2, 3, 4, 5, 11)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None]
    assert [out[i]["verdict"] for i in (0, 1, 2, 3, 9)] == ["allow", "block", "block", "allow", "block"]
    fitted = url_filter.url_filter(url_filter.labelled_urls(spark), url_filter.labelled_urls(spark), [("net/x", "block")])
    assert fitted.where((F.col("verdict") == "block") != (F.col("label") == 1)).count() == 0
    assert url_filter.url_filter(pages, url_filter.labelled_urls(spark).limit(0), rules).where("p_block != 0.5").count() == 0
    with pytest.raises(ValueError):
        url_filter.fit(url_filter.labelled_urls(spark), most=3)


def test_toxicity_gradient():
    w = {k: v.astype(np.float64) for k, v in toxicity.start().items()}
    r = np.random.default_rng(0)
    p, mask, d = r.normal(size=(5, 3, 6 * toxicity.HIDDEN)), np.ones((5, 3)), np.array([1.0, -2.0, 0.5])
    mask[3:, 1] = 0
    g, d_p = toxicity.backward(w, toxicity.forward(w, p, mask, keep=True), mask, d)
    for k in ("u0", "u1", "wa", "ba", "va", "wo", "bo"):
        at = tuple(r.integers(0, s) for s in w[k].shape)
        loss = [(toxicity.forward(w | {k: w[k] + e * (np.arange(w[k].size).reshape(w[k].shape) == np.ravel_multi_index(at, w[k].shape))}, p, mask) * d).sum() for e in (1e-2, -1e-2)]
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][at]) < 1e-3
    assert d_p.shape == p.shape


def test_toxicity_learns_and_handles_edges(spark, docs):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice([f"w{k}" for k in range(50)], 70).tolist() + (["vilest", "vilescum"] if i % 2 else [])), i % 2) for i in range(80)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(known.select("doc_id", "text"), known.select("doc_id", "label"))
    test = known.select(F.col("doc_id"), "text", F.lit(False).alias("held_out"))
    out = {x["doc_id"]: x["score"] for x in toxicity.toxicity(test, model).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(i % 2) for i in out]) > 0.95
    edge = toxicity.toxicity(docs.withColumn("held_out", F.lit(True)), model)
    assert edge.count() == docs.count() and edge.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.window_starts(100) == [0, 24, 48, 52] and toxicity.window_starts(0) == [0]
    none = toxicity.fit(docs.limit(0), known.select("doc_id", "label").limit(0))
    assert toxicity.toxicity(docs.withColumn("held_out", F.lit(True)).limit(0), none).count() == 0
    kept = toxicity.keep_clean(known.select("doc_id", "text"), model)
    assert all(x["doc_id"] % 2 == 0 for x in kept.collect()) and kept.count() >= 38


def test_bm25_equals_brute_force(docs, monkeypatch):
    rows = tuples(docs)
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for _, t in rows]
    n, mean = len(rows), sum(map(len, words)) / len(rows)
    df = Counter(w for ws in words for w in set(ws))
    monkeypatch.setattr(bm25, "BLOCK", 4)
    index = bm25.build(docs)
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text").dropDuplicates(["query_id"])
    got: dict = {}
    for r in bm25.search(index, queries, 5, most_queries=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q, t in [(r["query_id"], r["text"]) for r in queries.collect()]:
        want = []
        for (d, _), ws in zip(rows, words, strict=True):
            tf = Counter(ws)
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                    for w, c in Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))).items() if tf[w])
            if s > 0:
                want.append((-round(s, 9), -1 if d is None else d))
        want = sorted(want)[:5]
        mine = [(-round(s, 9), -1 if d is None else d) for _, d, s in sorted(got.get(q, []))]
        assert [d for _, d in mine] == [d for _, d in want] and np.allclose([s for s, _ in mine], [s for s, _ in want])
    assert bm25.search(bm25.build(docs.limit(0)), queries).count() == 0


def test_bm25_documents_as_queries(spark, docs, monkeypatch):
    from vulnlake.llm import queries
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 20 = 0 and text is not null").collect()}
    got = queries.QUERIES["op4_bm25_topk"](spark, SF).collect()
    assert {r["query_id"] for r in got} == ids
    index, asked = bm25.build(docs), docs.where("doc_id is not null").select(F.col("doc_id").alias("query_id"), "text")
    want = sorted(map(tuple, bm25.search(index, asked, 5).collect()))
    monkeypatch.setattr(bm25, "FIRST", 1)
    monkeypatch.setattr(bm25, "SHARD", 500)
    calls, block = [], bm25.search_block
    monkeypatch.setattr(bm25, "search_block", lambda *a: calls.append(1) or block(*a))
    small = sorted(map(tuple, bm25.search(bm25.build(docs), asked, 5, most_bytes=60_000).collect()))
    assert len(calls) > 1 and [r[:3] for r in small] == [r[:3] for r in want] and np.allclose([r[3] for r in small], [r[3] for r in want])


def test_bm25_scores_few_postings():
    """Whole documents as queries: pruning leaves out most postings, and never a result."""
    r = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(20_000)])
    chance = 1 / np.arange(1, 20_001)
    texts = [" ".join(r.choice(words, 120, p=chance / chance.sum())) for _ in range(2000)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:200] for _ in range(3)]
    row = bm25.invert([(i, t.encode()) for i, t in enumerate(texts)])
    shard = bm25.Shard(row, row["total"] / row["n"])
    df = np.diff(shard.start)
    every, least = 0, 0
    for q in range(0, 400, 4):
        own, times = np.unique(texts[q].split(), return_counts=True)
        t = np.array([int(np.flatnonzero(shard.part["terms"] == np.uint64(xxhash.xxh3_64_intdigest(w.encode())))[0]) for w in own])
        weight = times * np.log(1 + (row["n"] - df[t] + 0.5) / (df[t] + 0.5))
        before = shard.scored
        found = shard.top((shard.part["terms"][t], weight), 3)
        every, least = every + int(df[t].sum()), least + shard.scored - before
        score = np.zeros(row["n"])
        for i, w in zip(t, weight, strict=True):
            at = slice(shard.start[i], shard.start[i + 1])
            score[shard.part["posting"][at]] += w * shard.gain(shard.part["times"][at], shard.part["posting"][at])
        want = sorted(zip((-np.round(score, 9)).tolist(), range(row["n"]), strict=True))[:3]
        assert [d for d, _ in found] == [d for _, d in want] and np.allclose([s for _, s in found], [-s for s, _ in want])
        assert shard.top((shard.part["terms"][t], weight), 3, least=found[-1][1]) == found
    assert least < 0.35 * every, (least, every)


def test_langid(spark, docs):
    r = np.random.default_rng(1)
    make = {"en": ["the", "and", "thing", "with", "this"], "de": ["der", "und", "schön", "nicht", "über"]}
    rows = [(i, " ".join(r.choice(make[k], 30)), k) for i in range(60) for k in ("en", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False)), model)
    assert Counter(x["lang_pred"] for x in got.collect()) == {"en": 60, "de": 60}
    edge = langid.identify(docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0)), model).collect()
    assert len(edge) == docs.count()
    assert all((x["lang_pred"] == "und") == (x["doc_id"] in (62, 63, 64)) and 0 <= x["score"] <= 1 for x in edge)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in edge)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, encode = Tokenizer.from_file(path), packing.Encoder(path, "<u2")
    every, r = "".join(map(chr, range(256))), random.Random(4)
    texts = [every, every[::-1], " \x85\xa0 a  b \t\n\x1c", "a" + every + " x²½", "x <|endoftext|>y", "日本 a  b"]
    texts += ["".join(r.choice(every + "  '" + "st" * 9) for _ in range(40)) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == exact.encode(t, add_special_tokens=False).ids, t
    for targets in (None, {"s0": 0.9, "s1": 0.1}):
        pieces = packing.pack(docs, window=64, quantum=16, targets=targets).collect()
        used = Counter()
        by_seq: dict = {}
        for p in pieces:
            by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
            used[p["doc_id"]] += p["length"]
        want = Counter()
        ids = {}
        for d, t in tuples(docs):
            ids[d] = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
            want[d] += len(ids[d])
        assert used == want
        assert sorted(by_seq) == list(range(-(-sum(want.values()) // 64)))
        for s, xs in by_seq.items():
            xs.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(xs, xs[1:], strict=False)) and xs[0][0] == 0
            assert sum(n for _, n in xs) == 64 or s == max(by_seq)
        for p in pieces:
            part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_order_is_the_round_robin(spark):
    """The places of all pieces against a queue by queue simulation, and the mixture of every window."""
    r = np.random.default_rng(8)
    rows = [(i, " ".join(r.choice(["ab", "cd", "ef"], int(r.integers(1, 80)))), ["a", "b", "c"][min(2, int(r.integers(0, 6)))]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    window, quantum = 64, 8
    for targets in (None, {"a": 0.5, "b": 0.3, "c": 0.2}):
        pieces = packing.pack(docs, window=window, quantum=quantum, targets=targets).collect()
        size = {p["doc_id"]: p["doc_tokens"] for p in pieces}
        place = {(p["doc_id"], p["start"] + i): p["sequence_id"] * window + p["offset"] + i for p in pieces for i in range(p["length"])}
        assert len(place) == len(set(place.values())) == sum(size.values()) == max(place.values()) + 1
        queue: dict = {s: [] for s in "abc"}  # each source's tokens in the order placed
        source = {i: s for i, _, s in rows}
        for (doc, at), n in sorted(place.items(), key=lambda x: x[1]):
            queue[source[doc]].append((n, doc, at))
        for tokens in queue.values():  # a document's tokens stay in order
            last: dict = {}
            assert all(last.get(d, -1) + 1 == at and not last.update({d: at}) for _, d, at in tokens)
        weight = {s: Fraction(len(q)) for s, q in queue.items()} if targets is None else {s: Fraction(str(w)) for s, w in targets.items()}
        due = sorted((Fraction(2 * i + 1, 2) / weight[s], s, i) for s, q in queue.items() for i in range(-(-len(q) // quantum)))
        want = [n for _, s, i in due for n in [x[0] for x in queue[s][i * quantum:(i + 1) * quantum]]]
        assert want == list(range(len(place)))
        dry = min(-(-len(queue[s]) // window * 1) / float(weight[s]) for s in queue)  # until then every window holds the targets
        total = float(sum(weight.values()))
        for w in range(int(dry * total / 1) - 2):
            mine = Counter(s for s, q in queue.items() for n, _, _ in q if n // window == w)
            assert all(abs(mine[s] - window * float(weight[s]) / total) <= 2 * quantum for s in queue), (w, mine)


def test_quality(spark, docs):
    r = np.random.default_rng(2)
    good = [f"word{i} and then some{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(good, 40)) if i % 2 else "$$$ BUY!! " * 40 + str(i), i % 2) for i in range(120)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(known.select("doc_id", "text"), known.select("doc_id", "label"))
    out = quality.quality(known.select("doc_id", "text", F.lit(False).alias("held_out")), model).collect()
    assert np.mean([(x["score"] >= 0.5) == bool(x["doc_id"] % 2) for x in out]) > 0.95
    edge = quality.quality(docs.withColumn("held_out", F.lit(True)), model)
    assert edge.count() == docs.count() and edge.where("score is null or score < 0 or score > 1").count() == 0
    one = quality.fit(known.select("doc_id", "text"), known.select("doc_id", F.lit(1).alias("label")))
    assert quality.quality(docs.withColumn("held_out", F.lit(True)), one).where("score < 0.9").count() == 0


def test_quality_prior_is_that_of_all_labels(spark):
    r = np.random.default_rng(6)
    rows = [(i, " ".join(r.choice([f"word{k}" for k in range(30)], 60)), int(i % 10 > 0)) for i in range(600)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(known.select("doc_id", "text"), known.select("doc_id", "label"), docs_per_class=50)
    out = quality.quality(known.select("doc_id", "text", F.lit(False).alias("held_out")), model)
    assert out.agg(F.avg("score")).first()[0] > 0.8


def test_fm_index_finds_all():
    r = np.random.default_rng(1)
    for n, k in ((1, 3), (50, 3), (400, 2), (2000, 30)):
        s = r.integers(0, k, n)
        s[-1] = 0
        x = fm_index.FMIndex(s, 4)
        pats = [r.integers(1, k + 1, m) for m in r.integers(1, 6, 40)]
        which, place = x.locate(*x.search(pats))
        for i, q in enumerate(pats):
            assert sorted(place[which == i].tolist()) == [j for j in range(n - len(q) + 1) if (s[j:j + len(q)] == q).all()]


def test_decontaminate(spark, docs):
    rows = tuples(docs)
    bench = spark.createDataFrame([(1, " ".join(rows[3][1].split()[2:16]).replace("w", "W")), (2, "two  words"), (3, None), (4, "..."), (None, "w1"), (10, "Two words")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find(docs, bench).collect()}
    assert found[3]["n_hit"] >= 10 and 1 in found[3]["items"]
    assert (found[66]["n_hit"], found[66]["items"], found[66]["n_words"]) == (2, [2, 10], 2)
    assert found[62]["n_words"] == 0 and found[63]["items"] == []
    clean = {r["doc_id"]: r for r in decontaminate.remove(docs, bench).collect()}
    assert clean[66]["text"] == "" and clean[62]["text"] is None and clean[65]["text"] == {d: t for d, t in rows}[65]
    assert decontaminate.remove(docs, bench).columns == docs.columns
    after = decontaminate.find(spark.createDataFrame([clean[3]], docs.schema), bench).first()
    assert after["n_hit"] == 0 and after["n_words"] == found[3]["n_words"] - found[3]["n_hit"]
    assert decontaminate.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_brute_force(spark, block):
    r = np.random.default_rng(9)
    base = [r.choice([f"t{i}" for i in range(60)], 60).tolist() for _ in range(4)]
    rows = []
    for i in range(48):
        w = list(base[i % 4])
        for k in r.integers(0, 60, int(r.integers(0, 4))):
            w[k] = f"x{i}"
        rows.append((i + 1, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (104, "b a"), (None, "a b"), (102, "a b")]
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100), block).collect() if r["doc_id"]}
    sets = {}
    for d, t in rows:
        w = lower(t).split()
        sets[d] = {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    label = {d: d for d in sets if d}
    for _ in range(60):
        for a in label:
            for b in label:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {d: (x["n_shingles"], x["component_id"]) for d, x in got.items()} == {d: (len(sets[d]), label[d]) for d in label}


def test_lm_base_is_exact_and_model_better_than_nothing(docs, monkeypatch):
    for head in (3, 1 << 17):
        use = docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
        out = lm_score.score(use, lm_score.fit(use.where(~F.col("held_out")), head=head)).collect()
        toks = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"] for d, t in tuples(docs)}
        count = Counter(w for d, t in tuples(docs) if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for w in toks[d])
        n, v = sum(count.values()), len(count)
        assert len(out) == docs.count()
        for r in out:
            w = toks[r["doc_id"]]
            assert r["train_tokens"] == n and r["n_tokens"] == len(w) and r["n_known"] == sum(count[x] > 0 for x in w)
            assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
            assert r["score"] < 0
    assert lm_score.score(use.limit(0), lm_score.fit(use.limit(0))).count() == 0


def test_lm_filter_in_slices_loses_nothing(docs):
    use = docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    train = use.where(~F.col("held_out"))
    one, many = lm_score.fit(train), lm_score.fit(train, slice_bytes=8)
    assert len(one.slices) == 2 and len(many.slices) > 10
    key = ["doc_id", "n_tokens", "score"]
    assert sorted(map(str, lm_score.score(use, one).select(key).collect())) == sorted(map(str, lm_score.score(use, many).select(key).collect()))
    model = many.sent.value
    # ten bits for every entry: a part has room for all it was given, whatever the slices' size
    h = np.arange(1, 50_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(lm_score.build(h, np.ones(len(h), np.int64))) * 8 >= lm_score.ENTRY_BITS * len(h) and model.order == 2


def test_lm_bigrams_seen_once_count(spark):
    rows = [(i, t, False) for i in range(20) for t in (f"p{i} q{i} r{i}", f"p{i} q{i} r{i}", f"u{i} v{i}", f"u{i} x{i}")]
    train = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    test = spark.createDataFrame([(100 + i, f"u{i} v{(i + k) % 20}", True) for i in range(20) for k in (0, 1)], train.schema)
    got = {}
    for r in lm_score.score(test, lm_score.fit(train)).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert all(max(x) - min(x) > 0.3 for x in got.values())


def test_pipeline_cuts_lines_on_few_hundredths_of_a_source(spark):
    rows = [(i, f"text number {i}\n" + ("shared line" if i % 33 == 0 else f"own line {i}"), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, SF).collect()}
    assert out == {i: f"text number {i}" if i % 33 == 0 else t for i, t, _ in rows}


def test_pipeline_stages_keep_clashing_columns(spark, docs):
    odd = docs.withColumns({"_site": F.lit("x"), "_kept": F.lit(1), "component_id": F.lit(2), "a": F.lit(3), "a.b": F.lit(4), "items": F.lit(5)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert out.where("_site = 'x' and _kept = 1 and component_id = 2 and a = 3 and `a.b` = 4 and items = 5").count() == out.count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, odd, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert name == "jaccard_join" or out.count() == docs.count()
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    again = jaccard_join.jaccard_join(kept)
    assert again.where("component_id != doc_id").count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(20), SF).count() >= 20
