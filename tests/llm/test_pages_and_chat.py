"""Archives, main texts, preference pairs and the pipeline at the edges and against plain versions."""

import base64
import hashlib

import pytest

from clientela.llm import chat, html_text, warc
from clientela.llm.queries import SQL
from clientela.session import scratch_folder

SF = "/root/testdata/sf0.001"


def test_archives_round_trip(spark):
    pages = [(1, "u\n x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "v", None), (4, "w", ""),
             (5, "w", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = scratch_folder(spark, "warc")
    warc.write_warc(warc.mark_revisits(df), path, records_per_file=2)
    got = {int(r["record_id"]): r for r in warc.read_warc(spark, path).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: r["refers_to"] for i, r in got.items()} == {1: "2", 2: None, 3: "4", 4: None, 5: None}


def test_damaged_archives_are_refused():
    good = warc.gzip_member(warc.record_bytes("1", None, b"payload", None))
    assert len(list(warc.members(good + warc.EMPTY_MEMBER + good))) == 2
    with pytest.raises(warc.BadArchive):
        list(warc.members(good[:-3]))
    with pytest.raises(warc.BadArchive):
        warc.read_record(warc.record_bytes("1", None, b"payload", None).replace(b"payl", b"PAYL"))


def test_deep_blocks_close_what_they_opened():
    from clientela.llm import wrappers

    inner = "<div>" * 200 + "<p>deep</p><aside><div><p>advert</p></div></aside>" + "</div>" * 200
    page = f"<html><body><div><article><p>before</p>{inner}<p>behind</p></article></div></body></html>"
    said = wrappers.main_text(page, None)
    assert "before" in said and "deep" in said and "behind" in said
    assert "advert" not in said

    def holders(node, name):
        found = [node] if node.name == name else []
        return found + [x for c in node.children for x in holders(c, name)]

    (article,) = holders(wrappers.tree(page), "article")
    assert [c.children[0].text for c in article.children if c.name == "p"] == ["before", "behind"]


def test_main_texts(spark):
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul>"
        "<li><a>menu</a></li><li>b</li></ul></nav><div class=ad>buy</div><article><h1>Head {0}</h1>"
        "<p><b>One &amp; {0}<br>two<p>Three</p><div class='comments'><p>no</p></div></article>"
        "<footer>&copy;</footer>"
    )
    rows = [(i, f"http://h{i % 2}.example/", page.format(i)) for i in range(6)]
    rows += [(6, None, None), (7, "x", ""), (8, "x", "plain   text"), (9, "http://h0.example", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\n\nOne & {i} two\n\nThree"
    assert [got[i] for i in (6, 7, 8, 9)] == ["", "", "plain text", "a"]
    assert html_text.extract(df.limit(0)).collect() == []


def test_preference_pairs(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [
        (1, [("user", "q"), ("assistant", "yes")], [("user", "q"), ("assistant", "no")]),
        (2, [("user", "q")], [("user", "q")]),
        (3, None, [("assistant", None)]),
        (4, [("user", "<|im_end|>")], [("user", "q")]),
    ]
    df = spark.createDataFrame(rows, f"pair long, chosen {turn}, rejected {turn}")
    got = {r["pair"]: r for r in chat.format_pairs(df).collect()}
    assert got[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    assert [(s["text"], s["trained"]) for s in got[1]["chosen"]] == [
        ("<|im_start|>assistant\n", False), ("yes<|im_end|>", True), ("\n", False)
    ]
    assert got[2]["prompt_turns"] == 1 and got[2]["chosen"] == got[2]["rejected"] == []
    assert got[3]["prompt"] == "" and got[3]["chosen"] == []
    assert got[4]["prompt_turns"] == 0 and got[4]["chosen"][1]["text"] == "<| im_end|><|im_end|>"


def test_preference_query_agrees_with_sql(spark):
    from tests.compare import connect, differences

    import __spark_entry__ as entry

    df = entry.queries()["op1_preference"](spark, SF)
    assert differences(df, connect(SF), SQL["op1_preference"]) == []


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = dict(docs.select("doc_id", "text").collect())
    for _, stage in pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
    kept = docs.collect()
    assert kept and all(r["n_chars"] == len(r["text"]) for r in kept)
    assert all(len(r["text"]) <= len(texts[r["doc_id"]]) for r in kept)
    pieces = pipeline.packed(spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept}


def test_archives_keep_null_ids(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (7, None, "a"), (8, "v", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_folder(spark, "warc")
    warc.write_warc(warc.mark_revisits(df), path)
    got = sorted(((r["record_id"] or "", r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()))
    assert got == [("", "response", None), ("", "response", None), ("7", "revisit", "8"), ("8", "response", None)]
    path = scratch_folder(spark, "warc")
    warc.write_warc(warc.mark_revisits(df.limit(0)), path)
    assert warc.read_warc(spark, path).collect() == []


def test_every_conversation_is_paired_and_parts_anywhere(spark):
    from pyspark.sql import functions as F

    rows = [(c, t, ["user", "assistant"][t % 2], f"{c if t > 1 else 'hello'} {t}", 0, "x")
            for c in range(12) for t in range(1 + c % 5)]
    rows += [(50, None, None, None, 0, "x"), (50, 1, "assistant", "", 0, "x"), (None, 0, "user", "lost", 0, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, chosen int, prompt string")
    pairs = {r["conv_id"]: r for r in chat.parted_pairs(df).collect()}
    assert set(pairs) == {*range(12), 50}
    said = {c: [(r["role"], r["text"]) for r in p["chosen"]] for c, p in pairs.items()}
    ids = sorted(said)
    found = {r["conv_id"]: r for r in chat.format_pairs(chat.parted_pairs(df)).collect()}
    for c, following in zip(ids, [*ids[1:], ids[0]]):
        same = c % (len(said[c]) + 1)
        rejected = said[c][:same] + said[following][same:]
        assert [(r["role"], r["text"]) for r in pairs[c]["rejected"]] == rejected
        common = 0
        while common < min(len(said[c]), len(rejected)) and said[c][common] == rejected[common]:
            common += 1
        assert found[c]["prompt_turns"] == common
        assert len(found[c]["chosen"]) == 3 * (len(said[c]) - common)
        assert len(found[c]["rejected"]) == 3 * (len(rejected) - common)
    assert len({found[c]["prompt_turns"] for c in ids}) > 2
    assert chat.format_pairs(chat.parted_pairs(df.where(F.lit(False)))).collect() == []


def test_words_in_an_articles_class_do_not_remove_it(spark):
    page = "<body><nav>menu</nav>{}<div class='share'>share it</div><footer>end</footer></body>"
    kinds = {
        1: "<article class='post has-share'><p>Text one of some length.</p><div class='comments'>no</div></article>",
        2: "<article class='search-result story'><p>Text two of some length.</p></article>",
        3: "<article class='story comments'><p>Text three of some length.</p></article>"
           "<article class='card'>x</article>",
        4: "<main class='no-sidebar'><p>Text four of some length.</p></main>",
        5: "<article><p>Text five.</p><section class='comments'><article class='comment'>A long remark "
           "by a reader, longer than the text itself.</article></section></article>",
    }
    rows = [(i, f"http://h{i}.example/", page.format(k)) for i, k in kinds.items()]
    got = {r["page_id"]: r["text"] for r in html_text.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Text one of some length." and got[2] == "Text two of some length."
    assert got[3] == "Text three of some length.\n\nx"
    assert got[4] == "Text four of some length." and got[5] == "Text five."


@pytest.mark.parametrize("n", [1, 7, 8, 30])
def test_text_that_all_pages_of_a_host_share_stays(spark, n):
    page = "<body><nav>m</nav><article><h1>Report {0}</h1><p>All figures are in euro.</p><p>Body {0}.</p></article>"
    rows = [(i, "http://h.example/", page.format(f"number {i}")) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract(df).collect():
        assert r["text"] == f"Report number {r['page_id']}\n\nAll figures are in euro.\n\nBody number {r['page_id']}."


def test_expressions_match_the_pages_they_come_from(spark):
    import functools

    from clientela.llm import wrappers

    pages = [
        "<body><ul><li>a<li>b<li>c</ul><article><p>x<p>y</article></body>",
        "<body><ul><li>a</ul><article><h1>T</h1><p>x</article><footer>f</footer></body>",
        "<body><div>ad</div><ul><li>a<li>z</ul><article><p>only &lt;one&gt;; here</article></body>", "", None,
        "<table><tr><td>1<td>2<tr><td>3<td>4</table>",
    ]
    whole = functools.reduce(wrappers.align, [wrappers.folded(wrappers.tree(p)) for p in pages])
    assert all(wrappers.matches(whole, p) for p in pages)
    assert not wrappers.matches(whole, "<body><b>x</b><h6>other</h6></body>")
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)],
                               "page_id long, url string, html string")
    (row,) = html_text.expressions(html_text.infer_wrappers(df)).collect()
    assert row["host"] == "h.example" and row["expression"]
    real = spark.read.parquet(f"{SF}/pages.parquet").collect()
    by_host = {}
    for r in real:
        by_host.setdefault(r["url"].split("/")[2], []).append(r["html"])
    for htmls in by_host.values():
        whole = functools.reduce(wrappers.align, [wrappers.folded(wrappers.tree(p)) for p in htmls])
        assert all(wrappers.matches(whole, p) for p in htmls)


def test_labels_are_aligned_in_order_and_in_little_space():
    import random
    import time

    from clientela.llm import wrappers

    rng = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = wrappers.common_labels(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert len(found) >= longest(a, b) - 3 and wrappers.common_labels(a, list(a)) == [(i, i) for i in range(len(a))]
    a, b = ([rng.choice(["p", "h2", "ul", "table"]) for _ in range(30_000)] for _ in range(2))
    start = time.perf_counter()
    assert len(wrappers.common_labels(a, b)) > 5000
    assert time.perf_counter() - start < 5
