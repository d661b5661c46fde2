"""Pages, vectors, conversations and the pipeline."""

import re

import numpy as np
import pytest

import corpus_pipeline
from compare import compare, connect
from vigilake.llm import quotes, revisits, url_filter, vectors
from vigilake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_url_filter", "op7_revisits"])
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_automaton_against_expressions():
    rng = np.random.default_rng(1)
    alphabet = list("ab/.*?") + ["**"]
    globs = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(60)]
    urls = ["".join(rng.choice(list("ab/.cé"), rng.integers(0, 25))) for _ in range(150)] + [""]
    parts = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    wanted = [re.compile("".join(parts.get(t) or re.escape(t) for t in re.findall(r"\*\*|.", g))) for g in globs]
    got = url_filter.Automaton(globs).run(urls)
    for i, url in enumerate(urls):
        assert got[i].tolist() == [bool(w.fullmatch(url)) for w in wanted], url


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.ORG/es/x?y#z", "x://example.org/en/12", "x://notexample.org/es/", "x://com/fr/", "x://h.com?/fr/", "x://my.casino.net", "x://a.b/" + "c" * 20000]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")).collect()}
    assert all((rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == ("", "", None, "allow") for i in range(4))
    assert (rows[4].host, rows[4].path, rows[4].rule, rows[4].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (rows[5].rule, rows[6].rule, rows[7].rule, rows[8].rule) == ("example.org/en/1", "org/", "com/fr/", None)
    assert rows[9].verdict == "block" and rows[10].verdict == "allow"


def test_revisit_edges(spark):
    rows = [
        (1, "response", "http://www.A.org/x/", 100, {"ETag": '"1"', "Content-Type": "t", "Date": "d0"}), (2, "response", "http://a.org/x", 200, {"etag": '"2"'}),
        (3, "revisit", "https://a.org/x#f", 200, {"etag": 'W/"1"', "Date": "d1", "Content-Type": "no"}), (4, "revisit", "http://a.org/x?utm_a=1", 90_000_000, {"ETag": '"1"'}),
        (5, "revisit", "http://b.org/", 5, None), (6, "revisit", None, 5, None), (7, "revisit", "http://a.org/x", None, None), (8, "revisit", "http://a.org/x", 300, {}),
    ]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve(frame).collect()}
    assert (got[3].status, got[3].response_id, got[3].headers) == ("resolved", 1, {"etag": 'W/"1"', "content-type": "t", "date": "d1"})
    assert (got[4].status, got[4].response_id) == ("changed", 2) and got[8].status == "unproven"
    assert [got[i].status for i in (5, 6, 7)] == ["missing"] * 3
    assert revisits.resolve(frame.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16) * 0.25]) for i in range(200)] + [(300, [float(x) for x in base[0]]), (301, [float(x) for x in base[0]])]
    odd = [(400, None), (401, [0.0] * 16), (402, [None] + [1.0] * 15), (403, [float("nan")] * 16), (404, [1.0, 2.0]), (405, [2.0, 4.0]), (None, [1.0] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    for _ in range(len(ids)):
        label = np.minimum(label, np.where(near, label[None, :], 10**9).min(axis=1))
    for i, d in enumerate(ids):
        assert got[d] == (near[i].sum(), label[i], label[i] == d)
    assert all(got[i] == (0, i, True) for i in (400, 401, 402, 403)) and got[404] == (1, 404, True) and got[405] == (1, 404, False)
    assert got[None] == (0, None, True)


def test_codes_bound_every_cosine():
    v = np.random.default_rng(4).normal(size=(300, 32))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    rotated, packed, f = vectors.encode(unit, vectors.rotation(32))
    code = (np.unpackbits(packed, axis=1, count=32) * 2.0 - 1) / np.sqrt(32)
    g = rotated @ code.T
    assert (f * g + np.sqrt(1 - f**2) * np.sqrt(1 - g**2) >= unit @ unit.T - 1e-9).all()
    assert abs(np.mean(g / f - unit @ unit.T)) < 0.01


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "An answer\n\nOn Monday X wrote:\n> hello  THERE\n> second line"),
        (1, 2, "user", "More\n> An answer\n>> hello there\n>> second line"), (1, 3, "user", "> nobody said this\nfree"), (2, 0, "user", None), (2, 1, "user", "> hello there"),
        (None, 5, "user", "> x"), (3, 0, None, ""), (3, 0, None, ""),
    ]
    got = [r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == 9
    assert (by[1, 1].text, by[1, 1].reply_to, by[1, 1].thread) == ("An answer", 0, 0)
    assert (by[1, 2].text, by[1, 2].reply_to, by[1, 2].thread, by[1, 2].n_quotes, by[1, 2].n_linked) == ("More", 1, 0, 2, 2)
    assert (by[1, 3].text, by[1, 3].reply_to, by[1, 3].thread) == ("free", None, 3)
    assert by[2, 0].text == "" and by[2, 1].reply_to is None and by[1, 0].chat == "<|user|>\nHello there\nsecond line"


def test_quotes_of_repeated_lines_and_turns(spark):
    said = "On an earlier day they wrote:"
    texts = {
        0: "ok\nthanks\nalice", 1: f"first question\nok\n{said}\n> ok\n> thanks\n> alice",
        2: f"ok\nthanks\nthen this\n\n{said}\n\n> first question\n> ok",  # itself quotes, and most of its lines were said before
        3: "agreed\n> ok\n> thanks\n> then this", 4: "again\nthe same", 5: "again\nthe same", 6: "yes\n> again\n> the same",
        7: "one\n> agreed\ntwo\n> yes\nthree", 8: "good\n> one\n> two\n> three", 9: f"fine\n> good\n> {said}\n>> one\n>> two\n>> three",
        300: "again\nthe same", 600: "late\n> again\n> the same", 601: "ok\nthanks\nalone\nmore", 602: "ok\nthanks\nbob", 603: "part\n> ok\n> thanks\n> alone",
    }
    rows = [(1, t, "user", x) for t, x in texts.items()] + [(2, 8, "user", texts[3]), (1, 600, "user", "again\nthe same")]
    got = [r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    by = {r.turn: r for r in got if r.conv_id == 1 and not (r.turn == 600 and r.text != "late")}
    assert len(got) == len(rows)
    assert {t: r.reply_to for t, r in by.items()} == {0: None, 1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: 5, 7: 6, 8: 7, 9: 8, 300: None, 600: 300, 601: None, 602: None, 603: 601}
    assert [by[t].thread for t in (3, 6, 9, 600, 603)] == [0, 5, 5, 300, 601] and (by[9].n_quotes, by[9].n_linked) == (2, 2)
    assert all(r.reply_to is None for r in got if r.conv_id == 2)


def test_quotes_of_mails(spark):
    chats = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(quotes.as_mails(chats)).collect()}
    strip = " \t\n\x0b\x0c\r"
    for r in chats.collect():
        found = got[r.conv_id, r.turn]
        assert found.text == r.text.strip(strip) and found.reply_to == (r.turn - 1 if r.turn else None) and found.thread == 0


def test_long_and_branching_chains(spark):
    # Conversation 1 answers the turn before over three stretches; 2 jumps back.
    to = {(1, t): t - 1 for t in range(1, 700)} | {(2, t): (t // 2 if t % 7 else t - 1) for t in range(2, 300)} | {(3, 5): 2}
    got = {(r.conv, r.turn): r.root for r in quotes._roots(spark.createDataFrame([(c, t, v) for (c, t), v in to.items()], "conv long, turn long, to long")).collect()}
    assert set(got) == set(to)
    for (c, t), root in got.items():
        while (c, t) in to:
            t = to[c, t]
        assert root == t
    assert quotes._roots(spark.createDataFrame([], "conv long, turn long, to long")).count() == 0


def test_mails_across_stretches(spark):
    rows = [(1, t, "user", f"text {t}") for t in range(600)] + [(1, 255, "user", "a"), (None, 3, "user", None), (2, None, "user", "x"), (2, 7, None, None)]
    got = [(r.conv_id, r.turn, r.text) for r in quotes.as_mails(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert len(got) == len(rows) and {(None, 3, ""), (2, None, "x"), (2, 7, "")} <= set(got)
    said = {t: f"text {t}" for t in range(600)} | {255: "a"}
    for c, t, text in got:
        if c == 1 and t > 1 and text.startswith("text"):
            assert text == f"text {t}\nOn an earlier day they wrote:\n> {said[t - 1]}\n>> {said[t - 2]}"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < kept.count() < docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    words = {r.doc_id: len((r.text or "").split()) for r in kept.collect()}
    assert {r.doc_id for r in mixed} <= set(words) and abs(sum(r.n_words for r in mixed) - sum(words.values())) <= 20
