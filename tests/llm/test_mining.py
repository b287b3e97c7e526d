"""Hard negatives, byte-level BPE and phrases (operators 11 to 13) against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vulnlake.llm import bpe, phrases, queries
from vulnlake.llm import hard_negatives as hn

PATH = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, label long, vector array<long>, anchor boolean, rank int, score double, g int, k int, `a.b` int"


# ---------------------------------------------------------------- hard negatives
def brute_negatives(rows, positives=5, negatives=5, low=80, high=100):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    for i, label, v, anchor in rows:
        if anchor:
            mine = (label, np.array(v, "<i8").tobytes(), v)
            anchors[i] = min(anchors.get(i, mine), mine)
    out = []
    for a, (label, _, v) in anchors.items():
        near = sorted((-dot(v, x), i) for i, k, x, _ in rows if k == label and i != a)[:positives]
        for p, pid in near:
            window = sorted((-dot(v, x), i) for i, k, x, _ in rows if k != label and low * -p <= 100 * dot(v, x) <= high * -p)
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 2, 3, 4) for r in rows], VECTORS)


def cluster_rows(seed, n, dims, spread, scale=300):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims)) * scale
    c = r.integers(0, 6, n)
    x = np.rint(centres[c] + r.normal(size=(n, dims)) * spread).astype(int)
    return [(int(i), int(c[i] % 3 if i % 7 else (c[i] + 1) % 3), x[i].tolist(), i % 10 == 0) for i in range(n)]


@pytest.mark.parametrize(("spread", "chunk", "group"), [(2, 64, 16), (400, 1000, 5), (60, 37, 1000)])
def test_hard_negatives_brute_force(spark, spread, chunk, group):
    rows = cluster_rows(3, 400, 8, spread)
    rows += [(1000, 1, [0] * 8, True), (1001, 1, [0] * 8, False), (1002, 2, [], True), (1003, 2, [5], False), (1010, 9, [1] * 8, True)]  # zeros, short ones, no positive
    rows += [(500 + i, 1, rows[10][2], False) for i in range(12)] + [rows[20], rows[20], (30, 2, [7] * 8, True), rows[41], rows[41]]  # ties, repeated rows
    bad = [(None, 1, [1] * 8, True), (2000, None, [1] * 8, True), (2010, 1, None, True)]
    got = hn.hard_negatives(vectors(spark, rows + bad).repartition(3), chunk=chunk, group=group).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)


def test_hard_negatives_large_numbers_and_empty(spark):
    r = np.random.default_rng(1)
    rows = [(i, i % 2, [int(x) for x in r.integers(-2**30, 2**30, 3)], i % 5 == 0) for i in range(60)]
    assert sorted(tuple(x) for x in hn.hard_negatives(vectors(spark, rows)).collect()) == brute_negatives(rows)
    assert hn.hard_negatives(vectors(spark, [])).count() == 0
    assert hn.hard_negatives(vectors(spark, [(1, 1, [1], False)])).count() == 0
    with pytest.raises(Exception, match="int too big|too large|Overflow"):
        hn.hard_negatives(vectors(spark, [(0, 1, [2**40, 0], True), (1, 1, [2**40, 1], False), (2, 2, [2**39, 1], False)])).collect()


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    rows = cluster_rows(5, 3000, 16, 4)
    x = np.array([v for _, _, v, _ in rows])
    refs = hn.directions(x[:500], 16)
    part = hn.Rows(*hn.chunk_of(0, [i for i, *_ in rows], [k for _, k, *_ in rows], [a for *_, a in rows], [v for _, _, v, _ in rows], refs)[1:])
    low, high = hn.bounds(part.norms[:200], part.norms, *hn.angle_range(part.angles[:200], part.angles))
    dots = part.vectors[:200] @ part.vectors.T
    assert (low <= dots).all() and (dots <= high).all()
    at = np.flatnonzero(part.anchor)
    group = hn.Rows("<i8", 16, *(a[at].tobytes() for a in (part.ids, part.labels, part.anchor, part.norms, part.angles, part.vectors)))
    windows = [[hn.Best(-np.inf, np.inf, 5)] for _ in at]
    scored = hn.search(part, group, windows, same=True)
    assert scored < 0.2 * len(at) * len(rows)  # clustered rows: most are never scored
    assert r is not None


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 1, [float("nan")]), (6, 1, [float("inf")]), (7, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    kept = df.where(hn.usable(F.col("label"), F.col("embedding"))).select("vec_id", hn.quantised(F.col("embedding")).alias("q")).collect()
    assert [(r.vec_id, r.q) for r in kept] == [(1, [128, -1]), (7, [])]


# ---------------------------------------------------------------- BPE
def test_bpe_equals_the_library():
    exact, mine, r = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH), random.Random(3)
    alphabet = [chr(i) for i in range(32, 127)] + list("éüßñ  \n\t\r 　中文日本🎉🇩🇪́‍\x00\x1c\x85ſǅ٣Ⅷ") + ["<|endoftext|>", "the", "ing", " " * 5, "aaa", "123"]
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 30_000, " " * 9_999 + "y", "<|endoftext" * 3]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(5000)]
    texts += ["".join(r.choice("abcdeth in") for _ in range(200)) for _ in range(300)]
    for t in texts:
        ids = exact.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids, t
        assert mine.decode(ids) == exact.decode(ids, skip_special_tokens=False).encode(), t
    for _ in range(500):  # ids that spell no valid UTF-8
        ids = [r.randrange(50257) for _ in range(12)]
        assert mine.decode(ids) == exact.decode(ids, skip_special_tokens=False).encode()


def test_bpe_every_token_is_its_own_encoding_or_never_made():
    mine = bpe.ByteBPE(PATH)
    for t in random.Random(1).sample(sorted(mine.born), 3000):
        text = mine.bytes[t]
        try:
            word = text.decode()
        except UnicodeDecodeError:
            continue
        assert (mine.word(word) == [t]) == (t not in mine.parts or mine.border(*mine.parts[t], mine.born[t]))


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    exact, mine = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH)
    text = " ".join(f"word{i} things{i % 3}" for i in range(50))
    assert mine.encode(text) == exact.encode(text, add_special_tokens=False).ids and max(len(mine.words), len(mine.words.old)) <= 3


def test_bpe_rows(spark):
    exact = Tokenizer.from_file(PATH)
    rows = [(1, "Hello wörld", 9, "x"), (1, "Hello wörld", 9, "x"), (2, None, 9, "x"), (3, "", None, None), (None, "a b", 1, "x"), (4, "z" * 200_000 + " end", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string")
    want = []
    for i, t, *_ in rows:
        ids = ",".join(map(str, exact.encode(t or "", add_special_tokens=False).ids))
        want.append((i, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df).collect()), key=str) == sorted(want, key=str)
    assert {bytes(r.decoded).decode() for r in bpe.codes(df).collect()} == {t or "" for _, t, *_ in rows}
    assert bpe.digests(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="not a plain byte-level BPE"):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- phrases
def brute_phrases(rows, least, top, most=4, scale=2_000_000, cover=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        long = [p for p, a in c.items() if a >= least and len(p) > 1]
        scored = []
        for p in long:
            a = c[p]
            inside = max((c[q] for q in long if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=None)
            if inside is not None and 100 * inside >= cover * a:
                continue
            score, _, left, right = min((scale * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def text_rows(seed=4, texts=250):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "ÉTÉ", "日本", "a b", "x\x1cy", "New", "York", "city"]
    fixed = ["New York city hall", "in New York", "of the the the the", "a b a b a b", "W1 w2\tw3  w4"]
    rows = []
    for i in range(texts):
        parts = [r.choice(fixed) if r.random() < 0.5 else " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=r.randrange(1, 7))) for _ in range(r.randrange(0, 40))]
        rows.append((r.choice(["en", "de", None, "und"]) if i % 3 else "en", "".join(p + r.choice([". ", ", ", "\n", "; ", "! ", " ", "\x0b", ".."]) for p in parts)))
    rows += [rows[5]] * 30 + [("en", None), ("en", ""), ("fr", "...!?"), (None, "only three words"), ("en", "loop " * 20_000), ("xx", "one")]
    return rows


@pytest.mark.parametrize("every", [1, 5, 48])
def test_phrases_brute_force(spark, every):
    rows = text_rows()
    df = spark.createDataFrame([(t, lg, 1, "x", 2) for lg, t in rows], "text string, lang string, n long, phrase string, `a.b` int").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=8, top=40, every=every).collect())
    assert got == brute_phrases(rows, 8, 40)
    assert len({g[0] for g in got}) >= 3 and any(len(g[2].split(" ")) == 4 for g in got)


def test_phrases_empty_and_full_bitmap(spark, monkeypatch):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    rows = text_rows(9, 60)
    monkeypatch.setattr(phrases, "SEGMENT", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)  # lets nearly everything through: more work, the same rows
    monkeypatch.setattr(phrases, "TOGETHER", 2000)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5, top=30)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, 30)


def test_parse_counts_repeated_passages_once(spark):
    """Equal passages in different texts give equal chunks, and every token is some chunk's own once."""
    r = random.Random(2)
    passage = " ".join(f"p{r.randrange(500)}" for _ in range(2000))
    rows = [("en", f"start{i} here {passage} end{i}") for i in range(20)]
    d = phrases.parse(spark.createDataFrame(rows, "lang string, text string"), every=16).collect()
    assert max(x["times"] for x in d) == 20 and len(d) < 300
    assert sum(x["times"] * (len(bytes(x["chunk"]).split(b" ")) - (0 if x["last"] else 3)) for x in d) == 20 * 2003


def test_phrases_exact_beyond_64_bits(spark):
    """Scores of counts whose product with the scale passes 64 bits."""
    big = 3 * 10**13
    row = spark.createDataFrame([("en", "a b", big, 2 * big + 1, big + 5)], "lang string, phrase string, a long, l long, r long")
    got = row.select(phrases.score_of(2_000_000).alias("s")).first()["s"]
    assert got == 2_000_000 * big // (3 * big + 6)


def test_registered_as_contracts_ask(spark):
    q = queries.QUERIES
    assert q["op11_hard_negatives"](spark, "/root/testdata/sf0.001").columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert q["op12_bpe_codec"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert q["op13_phrases"](spark, "/root/testdata/sf0.001").columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
