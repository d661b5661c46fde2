"""Small hand-written inputs: quirks, sources, sinks and streams."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import compare
from vigilake.functions import dates, documents, listing as cells, sections, text
from vigilake.operators import dictionary, documents as ops, keywords, listing, reports, search, skew, substring, tables
from vigilake import plans
from vigilake.sources import exports, feeds, html, pages as articles
from vigilake.session import tune
from vigilake.operators import changes as ops_changes
from vigilake.streaming import changes as stream
from vigilake.streaming.changes import SCAN_SCHEMA, read_version, watch_folder


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("[PAIN IN EXTREMITY]\nY / Y / Y", [("PAIN IN EXTREMITY", "Y", "Y", "Y")]),
    ("[PAIN IN EXTREMITY_x0015__x0016_]_x000D_\nY / Y / Y", [("PAIN IN EXTREMITY", None, None, None)]),
    ("[a]\nY/Y/Y\n[b]\nN/Y/Y\n[c]\nN/N/Y", [("A", "Y", "Y", "Y"), ("B", "N", "Y", "Y"), ("C", "N", "N", "Y")]),
    ("Fatigue\nJaundice n\nY / N", [("FATIGUE", None, None, None), ("JAUNDICE N", None, None, None)]),
    ("", []),
])
def test_event_cells(spark, raw, want):
    got = one(spark, cells.parse_event_verbatim(F.lit(raw)))
    assert [(e["normalized_term"], e["seriousness"], e["listedness"], e["causality"]) for e in got] == want


def test_outcomes_keep_the_last_line(spark):
    assert one(spark, cells.parse_outcomes(F.lit("Pain - Unknown\nRash - x - y\nPAIN - Fatal"))) == {"RASH": "x - y", "PAIN": "Fatal"}


@pytest.mark.parametrize("raw, want", [
    ("5 Warnings", "Warnings and Precautions"), ("Warning", "Boxed Warning"), ("(5)", "Boxed Warning"),
    ("6.1 Adverse events (x)", "Adverse Reactions"), ("patient's well-being", "Patient'S Well-Being"),
])
def test_section_names(spark, raw, want):
    assert one(spark, sections.normalize_section_name(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("06/25/2026(SUPPL-25)", dt.datetime(2026, 6, 25)), ("25/06/2026", dt.datetime(2026, 6, 25)),
    ("JUNE 5, 2026", dt.datetime(2026, 6, 5)), ("5-jun-2026", dt.datetime(2026, 6, 5)), ("soon", None), (None, None),
])
def test_label_dates(spark, raw, want):
    assert one(spark, dates.parse_label_date(F.lit(raw).cast("string"))) == want


def test_date_range_errors(spark):
    check = lambda a, b: one(spark, dates.validate_date_range(F.lit(a), F.lit(b)))["error"]
    assert check("01-01-2025", "01-01-2026") is None
    assert check("01-01-2026", "01-01-2025") == "order"
    assert check("2025/01/01", "") == "startDate:format"
    assert check("", "31-02-2025") == "endDate:calendar"


def test_corrupted_text_and_salts(spark):
    assert one(spark, text.is_corrupted_text(F.lit("<a><b>x"))) is True
    assert one(spark, text.is_corrupted_text(F.lit("plain words"))) is False
    assert one(spark, text.strip_drug_salts(F.lit("Amikacin  Sulfate"))) == "amikacin"


def test_heading_citations_are_refused(spark):
    for line in ("See Section 16.1", "16.1 Adverse Events   24", "16.1% of subjects", "16 Risks were seen in many of them."):
        assert one(spark, documents.match_heading(F.lit(line))) is None
    assert one(spark, documents.match_heading(F.lit("Section 16.01: Risks")))["number"] == "16.1"


def test_missing_listing_header(spark):
    with pytest.raises(ValueError, match="Event Verbatim"):
        listing.read_line_listing(spark.createDataFrame([("1", 2, "d", "p")], "`Case Number` string, source_row int, dataset_id string, product_name string"))


def test_listing_from_csv(spark, tmp_path):
    path = tmp_path / "listing.csv"
    path.write_text('source_row,dataset_id,product_name,Case Number,Event Verbatim,Country\n2,d,P,C1,"[a]\nY/N/Y\n[a]",X\n'
                    '3,d,P,Case Number,Event Verbatim,Country\n4,d,P,C1,"[a]\n[b]",\n5,d,P,,x,\n')
    rows = listing.read_line_listing(spark.read.option("header", True).option("multiLine", True).csv(str(path)))
    events = {(r.source_row, r.position, r.normalized_term) for r in listing.explode_events(rows).collect()}
    # A repeated term inside the first row stays, later rows only add new ones.
    assert events == {(2, 1, "A"), (2, 2, "A"), (4, 4, "B")}


def test_running_values_across_blocks(spark):
    rows = [("k", i, i if i % 7 == 0 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = skew.carry_forward(df, ["k"], "o", F.col("v"), "last", block_size=8).collect()
    assert all(r["last"] == r["o"] // 7 * 7 for r in got)
    total = skew.running_sum(df, ["k"], "o", F.lit(1), "n", block_size=8).collect()
    assert all(r["n"] == r["o"] + 1 for r in total)


def test_last_loaded_term_wins(spark):
    terms = spark.createDataFrame([("g", "Broad", "PAIN", "1", True, 1), ("g", "Broad", "PAIN", "2", True, 2)],
                                  "smq_name string, scope string, pt_name_upper string, pt_code string, is_active boolean, load_order int")
    assert [r.pt_code for r in dictionary.lookup_terms(terms).collect()] == ["2"]


def test_unknown_status_is_refused(spark):
    a = spark.createDataFrame([("1", "c", "d", "CANDIDATE")], "case_number string, concern_id string, dataset_id string, status string")
    u = spark.createDataFrame([("1", "c", "d", "BAD", "r", 1), ("2", "c", "d", "RELEVANT", "r", 2)],
                              "case_number string, concern_id string, dataset_id string, status string, reviewer_id string, seq int")
    current, audit = search.update_assessments(a, u)
    assert {(r.case_number, r.status) for r in current.collect()} == {("1", "CANDIDATE"), ("2", "RELEVANT")}
    assert [r.previous_state for r in audit.collect()] == ["NEW"]


def brute_continue(parts):
    """Continuation by the rule, one table at a time."""
    out, open_table = [], None
    for p in parts:
        soc = any(w in p["original"][0].lower() for w in ("disorders",))
        if open_table and p["page"] - open_table["end"] in (0, 1) and (
            len(p["cols"]) == len(open_table["cols"]) or soc or "continued" in p["caption"].lower()
        ):
            open_table["end"] = p["page"]
        else:
            open_table = {"cols": p["cols"], "end": p["page"], "no": (open_table["no"] if open_table else 0) + 1}
        out.append(open_table["no"])
    return out


def test_continued_tables_equal_brute_force(spark):
    cols = (["Term", "N"], ["Term", "N", "P"], ["Cardiac disorders"])
    parts = [
        {"ord": i, "page": i // 2 + (i % 5 == 0), "caption": "x (continued)" if i % 11 == 0 else "x", "cols": cols[i * i % 3],
         "original": cols[2] if i % 4 == 1 else cols[0]} for i in range(60)
    ]
    df = spark.createDataFrame(
        [("d", p["ord"], p["page"], p["caption"], p["cols"], [["a"]], p["original"]) for p in parts],
        "doc string, ord long, page int, caption string, columns array<string>, rows array<array<string>>, original_columns array<string>")
    got = [r.table_no for r in tables.join_continued_tables(df).orderBy("ord").collect()]
    assert got == brute_continue(parts)


def test_page_takes_memory_in_proportion_at_any_depth():
    def held(depth):
        page = "<div>" * depth + "".join(f"<p>word{i} <b>bold</b><br></p>" for i in range(400)) + "</div>" * depth
        elements, tokens = html.parse_page(page)
        assert len(elements) == depth + 400 and elements[0]["last"] == len(elements) - 1
        numbers = sum(len(e["cells"]) + len(e["links"]) + len(e) for e in elements)
        return len(page), sum(map(len, tokens)) + numbers

    (size, flat), (deep_size, deep) = held(1), held(100)
    # 99 more elements and their tags, and no text again.
    assert deep - flat == 99 * 18 and deep < 2 * deep_size


def test_rich_text_and_cells_of_intervals(spark):
    page = "<div id=accordion><h3>T</h3><p>a <b>b</b> <strong></strong>c<br>d\te</p></div><table><tr><td><a href=x>1</a><a href=y>2</a></td><td>n\0<i>m</i></td></tr></table>"
    d = html.html_elements(tune(spark).createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").repartition(1))
    row = d.where("id = 1").select(
        F.transform(html.elements_of("p"), html.rich_of).alias("rich"), F.transform(html.elements_of("tr"), html.cells_of).alias("cells"),
        html.first_text("h3").alias("head"), html.first_text("h9").alias("none"), html.elements_of("tr")[0]["links"].alias("links")).first()
    assert row.rich == ["a <strong>b</strong> c\nd e"] and row.cells == [["12", "n\ufffdm"]]
    assert (row.head, row.none, row.links) == ("T", None, ["x", None])
    assert d.where("id > 1").select(F.sum(F.size("elements"))).first()[0] == 0


def test_stream_reads_and_splits_touched_buckets_only(spark, tmp_path):
    tune(spark)
    root = str(tmp_path / "tables")

    def arrive(batch_id, drugs, words, rows=5):
        batch = spark.createDataFrame(
            [(i, d, "ADVERSE REACTIONS", "s", words, "FDA_SRLC") for i, d in enumerate(drugs)],
            "seq long, drug_id long, section string, source_record_id string, updated_text string, source string").selectExpr(
            "*", "concat('drug ', drug_id) AS display_name", "'x' AS active_ingredient", "'' AS original_text", "CAST('2024-01-01' AS TIMESTAMP_NTZ) AS source_date", "'' AS fda_comment", "'https://x/' AS source_url",
            "CAST('2024-01-02' AS TIMESTAMP_NTZ) AS verified_at", "'Labeling Revision' AS change_type")
        stream.change_sink(root, bucket_rows=rows)(batch, batch_id)
        return stream.manifest(spark, root, batch_id)

    first = arrive(0, range(60), "first text of the section")
    assert sum(n for *_, n in first) == 60
    # Buckets with more than five rows went one bit further, and others did not.
    assert {b for b, *_ in first} <= {3, 4} and any(b == 4 for b, *_ in first)
    second = arrive(1, [7], "another text of the section")
    assert sum(written == 1 for _, _, written, _ in second) <= 2 and sum(n for *_, n in second) == 60
    arrive(2, [7, 100], "a third text of the section")
    changes = stream.read_version(spark, root, "changes", 9, ops_changes.CHANGES_SCHEMA)
    versions = stream.read_version(spark, root, "versions", 9, ops_changes.VERSIONS_SCHEMA)
    assert changes.count() == 61 and {r.updated_text for r in changes.where("drug_id = 7").collect()} == {"a third text of the section"}
    assert sorted((r.drug_id, r.version_number) for r in versions.collect()) == [(7, 1), (7, 2)]
    assert stream.read_version(spark, root, "changes", 0, ops_changes.CHANGES_SCHEMA).where("updated_text LIKE 'first%'").count() == 60


def brute_outline(rows):
    """Open groups of every term line, walked from the top."""
    out, stack = [], []
    for n, cells in rows:
        header = next(((i, c.strip()) for i, c in enumerate(cells) if c and "(smq)" in c.lower()), None)
        if header:
            stack = [g for g in stack if g[0] < header[0]] + [header]
            continue
        at = next((i for i, c in enumerate(cells) if c in ("Narrow", "Broad")), None)
        if at is not None and len(cells) > at + 3 and cells[at + 2] and cells[at + 3]:
            out.append((n, cells[at + 3].strip(), [g for _, g in stack]))
    return out


def test_outline_equals_the_walk_in_any_blocks(spark):
    rng = random.Random(4)
    rows = []
    for n in range(600):
        if rng.random() < 0.3:
            rows.append((n * 3, [None] * rng.randrange(5) + [f" g{n} (SMQ) "]))
        else:
            rows.append((n * 3, [None] * rng.randrange(4) + [rng.choice(["Narrow", "Broad", "x"]), "c", rng.choice(["t", None, ""]), f" {n} "][:rng.randrange(2, 5)]))
    want = brute_outline(rows)
    df = spark.createDataFrame([("s", n, c) for n, c in rows], "sheet_id string, row_no long, cells array<string>")
    for block in (7, 100, 65_536):
        got = [(r.row_no, r.pt_code, r.groups) for r in dictionary.outline_terms(df, block).orderBy("row_no").collect()]
        assert got == want and len(want) > 20


def test_outline_of_a_million_rows_is_spread(spark):
    rows = spark.range(1_000_000).selectExpr(
        "'one' AS sheet_id", "id AS row_no",
        "CASE WHEN id % 1000 = 0 THEN array(concat('g', id, ' (SMQ)')) ELSE array('Broad', 'c', 't', string(id)) END AS cells")
    found = dictionary.outline_terms(rows)
    held = found.groupBy(F.element_at("groups", 1).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    assert held.where("n = 999").count() == 1000 == held.count()
    # One sheet in 16 blocks.
    assert 1_000_000 // skew.BLOCK == 15


def brute_continued(parts):
    """Rows and columns of each part by the walk."""
    out, columns, last = [], [], None
    for p in parts:
        soc = "disorders" in (p["original"] or [""])[0].lower()
        rows = p["rows"]
        goes_on = last is not None and p["page"] in (last, last + 1) and (
            len(p["cols"]) == len(columns) > 0 or soc or "continued" in p["caption"].lower())
        if goes_on:
            if soc:
                own = [p["original"][0], *[""] * (len(columns) - 1)]
                rows = rows if rows[:1] == [own] else [own, *rows]
            heading = " ".join(columns)
            rows = [r for r in rows if r != columns and (soc or r != p["cols"]) and not all(c in heading for c in r if c)]
        else:
            columns = p["cols"]
        last = p["page"]
        out.append((goes_on, columns, rows))
    return out


def test_continued_tables_in_blocks_equal_the_walk(spark):
    rng = random.Random(5)
    cols = (["Term", "N"], ["Term", "N", "P"], ["Cardiac disorders"], [])
    parts = [{
        "ord": 3 * i, "page": i // 3 + (i % 7 == 0), "caption": rng.choice(["x", "x (Continued)", None]) or "", "cols": rng.choice(cols),
        "original": rng.choice([cols[2], cols[0], []]), "rows": [rng.choice([["Term", "N"], ["a", "b"], ["", None], ["Cardiac disorders", ""], ["Term"]]) for _ in range(3)],
    } for i in range(300)]
    df = spark.createDataFrame(
        [("d", p["ord"], p["page"], p["caption"], p["cols"], p["rows"], p["original"]) for p in parts],
        "doc string, ord long, page int, caption string, columns array<string>, rows array<array<string>>, original_columns array<string>")
    want = brute_continued(parts)
    for block in (5, 64, 65_536):
        got = [(r.is_continuation, r.columns, r.rows) for r in tables.join_continued_tables(df, block).orderBy("ord").collect()]
        assert got == want
    assert sum(g for g, _, _ in want) > 50


def test_substring_lookup_takes_the_rarest_gram(spark):
    # Every text has the first gram of the needle, few the last one.
    texts = spark.range(2000).selectExpr("concat('common', id % 500, CASE WHEN id % 500 < 3 THEN 'xyz' ELSE '' END) AS text")
    found = substring.candidates(
        spark.createDataFrame([("common1xyz",), ("nowhere",)], "needle string"), texts.distinct().withColumn("text_id", F.xxhash64("text")))
    pairs = substring.substring_join(
        spark.createDataFrame([("r", "COMMON1XYZ"), ("s", "n"), ("t", ""), ("u", None), ("v", "2_y"), ("w", "ommon49")], "id string, q string"),
        texts, F.col("q"), F.col("text"))
    assert found.count() <= 3
    assert dict(pairs.groupBy("id").count().collect()) == {"r": 4, "s": 2000, "t": 2000, "w": 44}
    wild = substring.substring_join(spark.createDataFrame([("a", "mm%x_z"), ("b", "%")], "id string, q string"), texts, F.col("q"), F.col("text"), wildcards=True)
    assert dict(wild.groupBy("id").count().collect()) == {"a": 12, "b": 2000}


def test_keywords_in_slices(spark):
    tune(spark)
    texts = spark.createDataFrame([(1, "abc abd"), (2, None), (3, "xbcx"), (4, "")], "id int, t string")
    words = spark.createDataFrame([("bc",), ("abd",), ("",), ("zz",), (None,)], "k string")
    for most in (1_000_000, 2):
        said = keywords.with_keywords(texts, "t", words, "found", most).select("id", F.explode("found").alias("k"))
        assert sorted(map(tuple, said.collect())) == [(1, "abd"), (1, "bc"), (3, "bc")]
    assert keywords.with_keywords(texts, "t", words.limit(0)).count() == 0


def test_html_elements_close_open_items():
    page = "<ul><li>a<li>b <a href='/x'>l</a></ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y"
    elements = html.parse_elements(page)
    assert [e["text"] for e in elements if e["tag"] == "li"] == ["a", "b l"]
    assert [e["cells"] for e in elements if e["tag"] == "tr"] == [["1", "2"], ["3"]]
    assert [e["text"] for e in elements if e["tag"] == "p"] == ["x", "y"]


@pytest.mark.parametrize("href, want", [
    ("/a", "https://h.org/a"), ("b?x", "https://h.org/p/b?x"), ("//c.org/z", "https://c.org/z"), ("#f", "https://h.org/p/q?r=1#f"),
    ("http://o.org", "http://o.org"), ("?n=2", "https://h.org/p/q?n=2"),
])
def test_resolved_links(spark, href, want):
    assert one(spark, html.resolve_url(F.lit("https://h.org/p/q?r=1#s"), F.lit(href))) == want


def test_dataset_reload_replaces_one_partition(spark, tmp_path):
    path = str(tmp_path / "events")
    exports.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, v int"), path, ["dataset_id"])
    for _ in range(2):
        exports.write_table(spark.createDataFrame([("a", 9)], "dataset_id string, v int"), path, ["dataset_id"], dynamic=True)
    assert sorted((r.dataset_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_folder_watch_processes_files_once(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "note.txt").write_bytes(b"no")
    for batch, new in enumerate((None, "b.pdf")):
        if new:
            (folder / new).write_bytes(b"two")
        watch_folder(spark, str(folder), root, str(tmp_path / "progress")).awaitTermination()
        seen = {r.filename for r in read_version(spark, root, "files", batch, SCAN_SCHEMA).collect()}
    assert seen == {"a.pdf", "b.pdf"}


def test_files_are_listed_without_content(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"1")
    (tmp_path / ".hidden.pdf").write_bytes(b"1")
    listed = feeds.list_files(spark, str(tmp_path))
    assert "content" not in listed.columns and [r.filename for r in listed.collect()] == ["x.pdf"]


def test_change_csv_is_quoted_minimally(spark, tmp_path):
    row = ("d", 5, 1, *["plain"] * 7, 'say "hi", ok', *["x"] * 4)
    df = spark.createDataFrame([row], ["drug_id", "section_order", "id", *exports.CSV_COLUMNS])
    exports.write_changes_csv(df, str(tmp_path / "csv"))
    lines = spark.read.text(str(tmp_path / "csv")).collect()
    assert '"say ""hi"", ok"' in lines[1].value and lines[1].value.startswith("plain,")


def test_dictionary_join_needs_no_python(spark):
    events = spark.range(3).select(F.lit("d").alias("dataset_id"), F.lit("A").alias("normalized_term"), F.col("id").alias("position"),
                                   F.lit("1").alias("case_number"), F.lit("[a]").alias("raw_verbatim"), F.lit(1).alias("source_row"))
    scope = spark.createDataFrame([("c", "d")], "concern_id string, dataset_id string")
    terms = spark.createDataFrame([("c", "SINGLE_PT", "A", "a", None, None, None, None, 1)],
                                  "concern_id string, search_method string, normalized_term string, matched_term string, pt_code string,"
                                  " smq_name string, smq_scope string, smq_code string, n_terms int")
    matched = search.match_terms(events, scope, terms)
    plan = matched._jdf.queryExecution().toString()
    assert "Python" not in plan and matched.count() == 3


def test_documents_are_read_whole(spark):
    pages = spark.createDataFrame([("a", n, "" if n <= 10 else "x" * 900) for n in range(1, 21)] + [("b", n, "Drugname" if n == 6 else "-") for n in range(1, 8)], "doc string, page_num int, text string")
    scanned = lambda **k: {r.doc: r.is_scanned for r in ops.needs_scan(pages, **k).collect()}
    assert scanned() == {"a": False, "b": True} and scanned(first_pages=10) == {"a": True, "b": True}
    named = lambda **k: {r.doc: r.is_product for r in ops.in_document_product(pages, F.lit("drugname"), F.lit(""), **k).collect()}
    assert named() == {"a": False, "b": True} and named(first_pages=5) == {"a": False, "b": False}
    blocks = spark.createDataFrame(
        [("a", 0, 1, "6 REACTIONS", "6", True, "heading"), ("a", 1, 1, "body", None, False, "paragraph"), ("a", 2, 2, "7 NEXT", "7", True, "heading"), ("a", 3, 3, "rest", None, False, "paragraph")],
        "doc string, ord long, page_num int, text string, section_number string, is_heading boolean, block_type string")
    bounds = lambda **k: sorted(r.ord for r in ops.label_section_bounds(blocks, "6", ["7"], ["REACTIONS"], ["NOWHERE"], **k).collect())
    assert bounds() == [0, 1] and bounds(contents_pages=2) == []
    first_page = F.lit("\n".join(f"16.{n} Heading" for n in range(9)) + "\nWonderdrug")
    assert one(spark, text.product_name_from_file(F.lit("document.pdf"), first_page)) == "Wonderdrug"
    assert one(spark, text.product_name_from_file(F.lit("document.pdf"), first_page, first_lines=8)) == "document"
    listed = spark.createDataFrame([(1, "Ring", "https://x/1", ""), (2, None, "https://x/ring", "")], "ordinal long, title string, url string, summary string")
    urls = lambda **k: {r.url for r in feeds.read_feed_items(listed.limit(0), listed, F.lit("Ring"), **k).collect()}
    assert urls() == {"https://x/1", "https://x/ring"} and urls(min_title=10) == set()
    page = spark.createDataFrame([(1, "https://x/", "<h1>T</h1><h2>H</h2><p>short</p><p></p><ul><li>a</li></ul>")], "page_id long, url string, html string")
    said = lambda **k: articles.parse_article(page, **k).first().sections[-1]["text"]
    assert said() == "short\na" and said(min_paragraph=30) == ""


@pytest.mark.parametrize("query", ["blocks_to_text", "paragraph_reflow", "subsection_split", "subsection_tables"])
def test_label_blocks_are_not_gathered_in_the_driver(spark, query):
    plan = plans.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def _pages_differ(spark, folder, query, *bodies):
    rows = [(i, "https://x/", f"<html><head></head><body>{b}</body></html>") for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    return compare(spark, con, query, plans.QUERIES[query], plans.ORACLES[query], str(folder))


def test_title_references_in_sql(spark, tmp_path):
    assert _pages_differ(
        spark, tmp_path, "html_elements", "<h1>a &amp b</h1>", "<h1>a&ampb &lt;i&gt; &notit; &#x41;&#66 &#150; &am &</h1>",
        "<h1>&nbsp;x&eacute;y &copy 1</h1>") is None


def test_section_17_cut_in_sql(spark, tmp_path):
    assert _pages_differ(
        spark, tmp_path, "sanitize_html", "<p>a</p><p>see 17 below</p><p>b</p>", "<p>1a</p>17<p>117 b</p><p>x ñ17 c</p>",
        "<p>a<b>10.17.0.1</b></p><p>z</p>", "<p>a</p><b>Patient  Counseling</b>c", "<p>17th</p><h5>17</h5>d") is None


def test_postings_by_dataset(spark):
    """An event meets only the concerns that cover its dataset."""
    events = spark.createDataFrame(
        [(d, "c1", 1, 1, "PAIN", "[Pain]") for d in ("d1", "d2", "d3")],
        "dataset_id string, case_number string, position long, source_row long, normalized_term string, raw_verbatim string")
    posted = spark.createDataFrame(
        [("T|PAIN", c, "SINGLE_PT", "Pain", True) for c in ("n1", "n2")],
        "key string, concern_id string, search_method string, matched_term string, of_events boolean")
    for c in ("pt_code", "smq_name", "smq_scope", "smq_code", "soc_name"):
        posted = posted.withColumn(c, F.lit(None).cast("string"))
    scope = spark.createDataFrame([("n1", "d1"), ("n2", "d2")], "concern_id string, dataset_id string")
    raw = search.match_events(events, search.scoped(posted.withColumn("n_terms", F.lit(1)), scope))
    assert {(r.concern_id, r.dataset_id) for r in raw.collect()} == {("n1", "d1"), ("n2", "d2")} and raw.count() == 2


def test_white_space_is_unicode(spark):
    odd = [chr(i) for i in range(0x3100) if chr(i).isspace()] + list("a\0​﻿")
    rows = spark.createDataFrame([(f"{c} {c}x{c}y{c}\n",) for c in odd] + [("",), ("\r\n",), (None,)], "v string")
    old = F.regexp_replace("v", r"(?U)^\s+|\s+$", "")
    lines = F.split("v", "\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]")
    assert rows.where(~old.eqNullSafe(text.strip(F.col("v"))) | ~lines.eqNullSafe(text.lines(F.col("v")))).count() == 0


def test_case_detail_deals_no_event_out(spark):
    """Events and products stay in their buckets: no window, and the one join
    that shuffles a side shuffles the terms of a case."""
    plan = plans.QUERIES["case_detail"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "BroadcastExchange" not in plan


def _plan(spark, name):
    return plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_case_are_dealt_out_once(spark):
    """Events, cases and their counts stay where the join by case put them."""
    plan = _plan(spark, "search_summary")
    dealt = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [d for d in dealt if "case_number" in d and "," in d.rsplit(",", 1)[0]]
    assert "listing_" not in _plan(spark, "list_cases") and "Generate" not in _plan(spark, "list_cases")


def test_few_and_many_keywords_agree(spark, monkeypatch):
    texts = spark.createDataFrame([("old ring and old rings",), ("ring",), (None,), ("none",)], "t string")
    words = spark.createDataFrame([("ring",), ("old ring",), ("",)], "k string")

    def said():
        return {(r.t, tuple(sorted(r.found))) for r in keywords.with_keywords(texts, "t", words, "found").collect()}

    few = said()
    monkeypatch.setattr(keywords, "FEW", 0)
    assert few == said() == {("old ring and old rings", ("old ring", "ring")), ("ring", ("ring",))}


def test_pages_are_parsed_once_for_mentions(spark):
    assert _plan(spark, "product_mentions").count("MapInPandas") == 1


@pytest.mark.parametrize("query", ["pt_summary", "concern_report"])
def test_reports_by_term_parse_the_events_once(spark, query):
    assert _plan(spark, query).count("Generate posexplode(_parsed") == 1


def test_terms_of_relevant_cases_else_of_pending_ones(spark):
    matches = spark.createDataFrame(
        [("a", "d", "1", "x"), ("a", "d", "1", "y"), ("a", "d", "2", "x"), ("b", "d", "2", "x"), ("b", "d", "3", "x"), ("b", "d", "3", "x"), ("c", "d", "2", "z")],
        "concern_id string, dataset_id string, case_number string, matched_term string")
    states = spark.createDataFrame(
        [("a", "d", "1", "RELEVANT"), ("b", "d", "2", "NOT_RELEVANT"), ("c", "d", "2", "NOT_RELEVANT")],
        "concern_id string, dataset_id string, case_number string, status string")
    got = {(r.concern_id, r.preferred_term, r.case_count) for r in reports.pt_summary(matches, states).collect()}
    assert got == {("a", "x", 1), ("a", "y", 1), ("b", "x", 1)}


def test_case_tables_are_written_where_they_are_dealt(spark):
    """No stored table needs a shuffle of its own, to be written or joined."""
    from vigilake.plans import listing_tables as t

    kept = t.CaseTables(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in kept.reviews.groupBy("case_number").count()._jdf.queryExecution().executedPlan().toString()
    for name, columns in (("events", ["case_number"]), ("products", ["dataset_id", "case_number"]), ("matches", ["dataset_id", "case_number"])):
        plan = getattr(kept, name).groupBy(*columns).count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
    assert "Exchange" not in _plan(spark, "case_detail")


def test_a_stored_pass_searches_once(spark, tmp_path):
    """The search is written as it runs, figures are counted from what is stored."""
    seen = spark.sparkContext.accumulator(0)

    def searched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "concern_id string, dataset_id string, case_number string"
    matches = spark.createDataFrame([("a", "d", "1"), ("a", "d", "1"), ("a", "d", "2")], schema).coalesce(1).mapInArrow(searched, schema)
    scope = spark.createDataFrame([("a", "d"), ("b", "d")], "concern_id string, dataset_id string")
    stored, metrics = search.store_run(str(tmp_path), matches, scope, "20240101120000", "me")
    for _ in range(2):
        search.store_run(str(tmp_path), stored, scope, "20240201120000", "me", metrics)
    assert seen.value == 3
    tables = search.stored_runs(spark, str(tmp_path))
    runs = {(r.id, r.is_active, r.candidate_events_count, r.distinct_cases_count) for r in tables["search_runs"].collect()}
    assert runs == {(f"run_{c}_d_{s}", s == "20240201120000", n, m) for c, n, m in (("a", 3, 2), ("b", 0, 0)) for s in ("20240101120000", "20240201120000")}
    assert tables["search_matches"].count() == 6 and tables["audit_logs"].count() == 4
