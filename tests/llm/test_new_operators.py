"""Tokenizer alignment, language-model scores and resampling against brute
force, and their edge cases."""

import hashlib
import os
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import align, ngram, packing, resample
from vigilake.llm.queries import QUERIES
from vigilake.llm.trie import CHANCES, Rising, Trie, quantised

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, id string, bucket string, n string, weight string, score string, chunk string, rank string, pairs string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in zip(ids, texts, strict=True)], CLASHING)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def folded(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


# --- resampling ----------------------------------------------------------------

def resampled(rows, target, least=20):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t)) for _, t in rows]
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s = Counter(bucket(w) for ws in words for w in ws)
    t = Counter(bucket(w) for x in target for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(bucket, ws))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = 10 * len(may) // 100
    return sorted(([(*r, n + 1) for n, r in enumerate(may[:k])] + [(*r, None) for r in may[k:]] + [(*r, None) for r in out if r[1] < least]), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert told(QUERIES["op13_resampling"](spark, SF)) == resampled(docs, target)


def test_resampling_edges(spark):
    texts = [None, "", "x" * 5000, "Ab ab_AB é1 " * 40, "b c " * 30, "b c " * 30, "b c " * 30, "a " * 19, "a " * 20] * 4
    ids = [None, *range(1, 36)]
    ids[5] = ids[4]  # one row twice
    docs, target = frame(spark, texts, ids), frame(spark, ["b b c", None])
    assert told(resample.resampled(docs, target)) == resampled(list(zip(ids, texts, strict=True)), ["b b c"])
    assert told(resample.resampled(docs, target.limit(0))) == resampled(list(zip(ids, texts, strict=True)), [])
    assert told(resample.resampled(docs.limit(0), target)) == []
    # The same id and text everywhere: all tie, and still a tenth is drawn.
    same = frame(spark, ["b " * 25] * 60, [7] * 60)
    assert sum(r[4] is not None for r in told(resample.resampled(same, target))) == 6


def test_resampling_bracket_widens_and_runs_are_longer(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(300)).alias("score"))
    every = sorted((r.score for r in rows.collect()), reverse=True)
    for k in (1, 17, 2500, 4999, 5000):
        for accuracy, margin in ((10_000, None), (3, 1e-9), (100, 0.0)):
            low, high, above = resample.bracket(rows, "score", 5000, k, accuracy, margin)
            assert low <= every[k - 1] <= high and above == sum(s > high for s in every) < k
    assert resample.buckets_of([b"a", b"b", b"c"], 2, 1000).tolist() == [zlib.crc32(w) % 1000 for w in (b"a", b"b", b"c", b"a b", b"b c")]


# --- alignment -------------------------------------------------------------------

TOKENIZERS = pytest.mark.skipif(not os.path.isdir(align.FOLDER), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.FOLDER}/{align.BYTE_LEVEL}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.PIECES}")


def token_bytes(tokenizers, text):
    """(id, bytes) of all tokens of a whole text, without any spans."""
    a, b = tokenizers
    letters = align.byte_letters()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()) for i in b.encode(text)]
    return one, two


def aligned(tokenizers, rows):
    told = []
    for _, text in rows:
        one, two = token_bytes(tokenizers, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in one) != raw or b"".join(t for _, t in two) != raw:
            told.append(([], [], ""))
            continue
        ends = [np.cumsum([len(t) for _, t in x]).tolist() for x in (one, two)]
        begins = [[e - len(t) for e, (_, t) in zip(e_, x)] for e_, x in zip(ends, (one, two))]
        links, i = [], 0
        for n, (j, _) in enumerate(two):
            while ends[0][i] <= begins[1][n]:
                i += 1
            k = i
            while k < len(one) and begins[0][k] < ends[1][n]:
                links.append((one[k][0], j))
                k += 1
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, x, y = [], 0, 0
        for e in both:
            u, v = ends[0].index(e, x) + 1, ends[1].index(e, y) + 1
            groups.append(",".join(str(t) for t, _ in one[x:u]) + "|" + ",".join(str(t) for t, _ in two[y:v]))
            x, y = u, v
        told.append((links, [len(one), len(two), len(groups)], hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for links, *_ in told for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return sorted((
        (i, *(n or [0, 0, 0]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha)
        for (i, _), (links, n, sha) in zip(rows, told, strict=True)), key=repr)


def spans(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


STRANGE = [
    None, "", " ", "  ", "\n", "a", "a ", " a", "a\nb", "a \n b\n\n  c", "tab\tand\r\nlines;\r\n x)\r", "h\u00e9llo \U0001f600 x", "\u2581x y", "a\u2581 b", "\u00e0\u4e2d\u6587\u5b57 \u0645\u0631\u062d\u0628\u0627",
    "e\u0301 \ufb01 \u212b \u00a0x\u3000y \u2009z", "don't 've we're 12 3.4 a_b", "<|endoftext|> </s> <0x41> <unk>", "x" * 3000, "word " * 20000, "\U0001f469\u200d\U0001f4bb \x1c\x1dx \x00 y", "nul\x00", "\u0085a \x0bb",
    "\ud55c\uad6d\uc5b4 " * 30, "x  y   z    w" * 50, "word", "word",
]


@TOKENIZERS
def test_alignment_equals_brute_force(spark, tokenizers):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert spans(QUERIES["op11_alignment"](spark, SF)) == aligned(tokenizers, docs)
    ids = [None, None, *range(len(STRANGE) - 2)]
    odd = frame(spark, STRANGE, ids)
    want = aligned(tokenizers, list(zip(ids, STRANGE, strict=True)))
    assert sum(r[1] > 0 for r in want) > 18
    # All in one row, and each document in its own.
    for size in (align.CHUNK, 1):
        assert spans(align.aligned(odd, size=size)) == want
    assert spans(align.aligned(odd.limit(0))) == []


@TOKENIZERS
def test_alignment_in_blocks_and_after_forgetting(monkeypatch, tokenizers):
    files = [open(f"{align.FOLDER}/{name}", "rb").read() for name in (align.BYTE_LEVEL, align.PIECES)]
    texts = [t for t in STRANGE if t and len(t) < 10000]
    whole = align.Aligner(*files).chunk(texts)
    monkeypatch.setattr(align, "BLOCK", 2)
    monkeypatch.setattr(align, "KNOWN", 1)
    pieces = align.Aligner(*files)
    for told in (pieces.chunk(texts), pieces.chunk(texts)):
        assert all(np.array_equal(told[c], whole[c]) for c in whole)


def test_alignment_spans_and_packing():
    # Two tokens share a character: their spans are 2 bytes, they hold 1 each.
    assert align.ends(*map(np.array, ([0, 0, 2], [2, 2, 5], [1, 1, 3]))).tolist() == [1, 2, 5]
    pairs, every, common = align.linked(*map(np.array, ([1, 2], [2, 5], [7, 8, 9], [1, 2, 5])))
    assert pairs.tolist() == [1 << 32 | 7, 1 << 32 | 8, 2 << 32 | 9] and every.tolist() == [1, 2, 5] and common.tolist() == [2, 5]
    rng = np.random.default_rng(3)
    lists = [rng.zipf(1.2, 100_000) % (1 << 31), rng.integers(0, 300, 70_000), np.array([0, 255]), np.array([], dtype=np.int64), np.array([1 << 40, 3, 0, 1, 2]), np.array([65535]), np.array([(1 << 64) - 1, 5, 1 << 63], dtype=np.uint64)]
    assert [x.tolist() for x in packing.unpack(packing.pack(*lists))] == [x.tolist() for x in lists]


# --- language model ----------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scored(rows, priors=(ngram.PRIOR_2, ngram.PRIOR_3), rounded=True):
    """The model from counts in dictionaries."""
    near = (lambda x: CHANCES[quantised(np.array([x]))[0]]) if rounded else float
    texts = [(i, zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False, [*WORD.findall(folded(t)), None]) for i, t in rows]
    one, two, three, seen = Counter(), Counter(), Counter(), Counter()
    for _, held, words in texts:
        if held:
            continue
        one.update(words)
        seen["<s>"] += 1
        two.update(zip(["<s>", *words], words))
        three.update(zip(["<s>", *words], words, words[1:]))
    n, types = sum(one.values()), len(one)
    out = []
    for i, held, words in texts:
        base = model = 0.0
        for k, w in enumerate(words):
            b = (one[w] + 0.5) / (n + 0.5 * (types + 1))
            v = words[k - 1] if k else "<s>"
            c = one[v] if k else seen["<s>"]
            p = (near(two[v, w] / (c + priors[0])) if two[v, w] else 0) + priors[0] / (c + priors[0]) * b
            if k:
                u = words[k - 2] if k > 1 else "<s>"
                c2 = two[u, v]
                p = (near(three[u, v, w] / (c2 + priors[1])) if three[u, v, w] else 0) + (near(priors[1] / (c2 + priors[1])) if c2 else 1.0) * p
            base, model = base + math.log10(b), model + math.log10(min(p, 1.0))
        out.append((i, held, len(words), sum(one[w] > 0 for w in words), n, base, model))
    return sorted(out, key=lambda r: (repr(r[:5]), r[5], r[6]))


def lm(df):
    return sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=lambda r: (repr(r[:5]), r[5], r[6]))


def same(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_scores_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = lm(QUERIES["op12_lm_scores"](spark, SF))
    same(got, scored(docs))
    # A code is half a step off at most, and the model beats the base.
    exact = scored(docs, rounded=False)
    assert all(abs(g[6] - e[6]) < 1.01 / 48 * g[2] for g, e in zip(got, exact, strict=True))
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_scores_edges(spark):
    texts = [None, "", "A b a B c", "a b a b", "x" * 70000, "new words here", "\u00e9 \u00c9 \x0b y", "a b c " * 5000] * 3
    ids = [None, *range(1, 24)]
    ids[5] = ids[4]
    docs = frame(spark, texts, ids)
    want = scored(list(zip(ids, texts, strict=True)))
    same(lm(ngram.scored(docs, ngram.held_out())), want)
    # Chunks of one document, and few n-grams to a shard.
    same(lm(ngram.scored(docs, ngram.held_out(), size=1, shard=3, least_shards=1)), want)
    assert lm(ngram.scored(docs.limit(0), ngram.held_out())) == []
    # Nothing to learn from: every word is an unknown one, of chance 1.
    assert {r[3:] for r in lm(ngram.scored(docs, F.lit(True)))} == {(0, 0, 0.0, 0.0)}


def test_rising_sequences():
    rng = np.random.default_rng(1)
    for top, n in ((0, 5), (1, 1000), (10**6, 3), (10**12, 500), (700, 700), (5 * 10**6, 20000)):
        values = np.sort(rng.integers(0, top + 1, n))
        parts = Rising.parts(values)
        held = Rising(int(parts[0][0]), int(parts[0][1]), *parts[1:])
        for start, stop in ((0, n), (n // 3, n // 2), (n - 1, n), (5, 5), (0, n + 9)):
            assert held[start:stop].tolist() == values[start:stop].tolist()
    assert Rising(0, 0, *Rising.parts(np.zeros(0, np.int64))[1:])[0:4].tolist() == []
    # 20,000 values below five million: 10 bits each, and half as many as the unary ones for the directory.
    assert sum(a.nbytes for a in Rising.parts(values)[1:]) < 20000 * 12 / 8


def test_trie_search(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.zipf(1.5, (4000, 2)) % 300, axis=0)
    triples = np.unique(np.stack((rng.integers(0, len(pairs), 9000), rng.zipf(1.3, 9000) % 400), axis=1), axis=0)
    in_2, in_3 = rng.random(len(pairs)) < 0.6, rng.random(len(triples)) < 0.6
    in_3 &= in_2[triples[:, 0]]
    trie = ngram.learned_trie(pairs[:, 0], pairs[:, 1], np.full(len(pairs), 9), in_2 * 3, triples[:, 0], triples[:, 1], in_3 * 2, (1.0, 1.0))
    monkeypatch.setattr("vigilake.llm.trie.BATCH", 100)
    code_2, weight, code_3 = trie.search(pairs[:, 0], pairs[:, 1], triples[:, 0], triples[:, 1])
    want = quantised(np.array([3 / 10, 1 / 4, 2 / 4]))
    assert np.array_equal(code_2, in_2 * want[0]) and np.array_equal(weight, in_2 * want[1]) and np.array_equal(code_3, in_3 * want[2])
    # The same bytes, mapped from a file.
    import mmap

    root, of = np.unique(pairs[:, 0], return_inverse=True)
    block = Trie.laid_out(root, of, pairs[:, 1], code_2, weight, triples[:, 0], triples[:, 1], code_3)
    (tmp_path / "trie").write_bytes(block[:])
    with open(tmp_path / "trie", "rb") as file:
        again = Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        assert all(np.array_equal(x, y) for x, y in zip(again.search(pairs[:, 0], pairs[:, 1], triples[:, 0], triples[:, 1]), (code_2, weight, code_3)))
