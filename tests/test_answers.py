"""Claims, citation checks, repair, prompts, refusals and sections on literal cases."""

import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from evidentia import queries as Q
from evidentia.functions.entities import unescaped
from evidentia.operators import answers as A
from evidentia.operators import pages
from evidentia.operators import sections as S

SF = "/root/testdata/sf0.001"
RECORD = ("[1]", "d", "c1", 0, 5)
SCHEMA = f"id string, answer string, citations {A.CITATIONS}, is_refusal boolean, message string"


def _claims(spark, text):
    rows = A.claims(spark.createDataFrame([("x", text)], "id string, answer string"), "id").orderBy("claim_index").collect()
    for r in rows:
        assert text[r.start_offset : r.end_offset] == r.text
    return [(r.kind, r.text) for r in rows]


def test_claims(spark):
    assert [k for k, _ in _claims(spark, "First point. Second point!\n- a bullet\n1. another")] == [
        "sentence", "sentence", "bullet", "bullet"
    ]
    assert _claims(spark, "Ask Dr. Ito, vs. the others, etc. about it [1]. Nobody else knows") == [
        ("sentence", "Ask Dr. Ito, vs. the others, etc. about it [1]."), ("sentence", "Nobody else knows")
    ]
    assert [t for _, t in _claims(spark, "One.\r\n* two. three\rFour")] == ["One.", "* two. three", "Four"]
    assert _claims(spark, " \n\n") == [] and _claims(spark, None or "") == []


CASES = [
    ("two cited", "One [1]. Two [1].", [RECORD], "valid", []),
    ("uncited", "One [1]. Two.", [RECORD], "retry", ["missing_citation_coverage"]),
    ("malformed", "One [one].", [RECORD], "retry", ["malformed_citation_marker", "missing_citation_coverage"]),
    ("unknown", "One [2].", [RECORD], "retry", ["unknown_citation_marker"]),
    ("absent chunk", "One [1].", [("[1]", "d", "other", 0, 5)], "retry", ["non_retrieved_chunk"]),
    ("too far", "One [1].", [("[1]", "d", "c1", 0, 999)], "retry", ["offset_out_of_range"]),
    ("twice", "One [1].", [RECORD, RECORD], "retry", ["duplicate_citation_marker"]),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(name, text, records, False, None) for name, text, records, *_ in CASES]
    rows += [
        ("refusal", A.MESSAGES["no_relevant_docs"], [], True, A.MESSAGES["no_relevant_docs"]),
        ("false refusal", "Pods run.", [], True, "Pods run."), ("null", None, None, None, None)
    ]
    contexts = spark.createDataFrame(
        [(r[0], "c1", "a text of the chunk", 10, 29) for r in rows],
        "id string, chunk_id string, text string, start_offset int, end_offset int"
    )
    return A.validated(spark.createDataFrame(rows, SCHEMA), contexts, "id"), contexts


def test_citations(checked):
    got = {r.id: (r.outcome, [f.code for f in r.failures]) for r in checked[0].collect()}
    for name, _, _, outcome, codes in CASES:
        assert (got[name][0], sorted(got[name][1])) == (outcome, codes), name
    assert got["refusal"] == ("valid", []) and got["false refusal"] == ("refuse", ["refusal_answer_contradiction"]) and got["null"] == ("retry", ["blank_answer"])


def test_repair(checked):
    fixed = A.repaired(checked[0], "id")
    got = {r.id: r.answer for r in fixed.collect()}
    assert got["uncited"] == "One [1]. Two [1]." and got["malformed"] == "One [one]." and got["null"] is None
    again = A.validated(fixed.drop("failures", "outcome"), checked[1], "id")
    assert again.where("id = 'uncited'").first().outcome == "valid"


def test_refusals_end_with_a_next_step(spark):
    rows = spark.createDataFrame([(1, "full"), (2, "no_relevant_docs"), (3, "out_of_scope")], "id int, decision string")
    said = {r.id: r.message for r in A.refusals(rows, "id", next_step=" Try another ").collect()}
    assert said == {
        2: A.MESSAGES["no_relevant_docs"] + " Next step: Try another.", 3: A.MESSAGES["out_of_scope"] + " Next step: Try another."
    }
    assert {r.message for r in A.refusals(rows, "id").collect()} == {A.MESSAGES["no_relevant_docs"], A.MESSAGES["out_of_scope"]}
    with pytest.raises(ValueError):
        A.refusals(rows, "id", next_step=" ")


MARKDOWN = """---
title: 'Tea, a manual'
Author : nobody
---
Before you *begin* read [the notes](http://tea.example/notes) , all of them.

## Water ##

1. Boil it &amp; wait.
- not `too` long

### Leaves

~~~
# how much
  spoon: 1
~~~
> as __strong__ as you like

#### 

## Cups
"""


def test_markdown(spark):
    docs = spark.createDataFrame(
        [(1, MARKDOWN), (2, None), (3, "---\ntitle: only\n---\n"), (4, "no heading"), (5, "# Alone\n\n## Below")],
        "doc_id long, text string"
    )
    rows = S.sections(docs, S.MARKDOWN).orderBy("doc_id", "section_index").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [r.section_path for r in one] == [["Tea, a manual"], ["Tea, a manual", "Water ##"], ["Tea, a manual", "Water ##", "Leaves"]]
    assert [r.text for r in one] == [
        "Before you begin read the notes, all of them.", "Boil it & wait.\nnot too long",
        "how much\nspoon: 1\nas strong as you like\n\n####"
    ]
    assert all(b.start_offset == a.end_offset + 2 for a, b in zip(one, one[1:])) and one[0].start_offset == 0
    assert [(r.doc_id, r.section_path, r.heading, r.text, r.section_id) for r in rows if r.doc_id != 1] == [
        (4, ["Untitled Document"], None, "no heading", "4-sec-0000"), (5, ["Alone"], None, "Alone\n\nBelow", "5-sec-0000")
    ]


def test_html(spark):
    def read(page, name=None, kind=S.PAGE):
        docs = spark.createDataFrame([(1, page, name)], "doc_id int, text string, name string")
        return S.sections(docs, kind, name_col="name").orderBy("section_index").collect()

    page = "<html><head><title>Bread</title><style>b {}</style></head><body><header><p>menu</p></header><p>Flour<b>and</b>water , salt.<h2>Oven</h2><ul><li>Heat <i>it</i>!<li>Wait</ul><h4>Crust</h4><pre>minutes:\n    first : 20\n\n\n\n    then: 15</pre><div>loose</div></body></html>"
    rows = read(page)
    assert [r.section_path for r in rows] == [["Bread"], ["Bread", "Oven"], ["Bread", "Oven", "Crust"]]
    assert [r.text for r in rows] == ["Flour and water, salt.", "Heat it!\n\nWait", "minutes:\n first : 20\n\n then: 15"]
    assert read(None) == [] and read("bare &amp; text", "my-file_two.html")[0].section_path == ["My File Two"]
    assert [(r.section_path, r.text) for r in read("<h1>One</h1><h2>Two</h2>", "a/b.HTM", S.BY_NAME)] == [(["One"], "One\n\nTwo")]
    assert [r.text for r in read("<ul><li>a<ol><li>b<li>c</ol>d<li>e</ul><p>f", "x")] == ["a b c d\n\ne\n\nf"]
    assert read("<h1>One</h1>", "b.md", S.BY_NAME)[0].text == "One"


def test_page_blocks_from_sql(spark):
    pages.register(spark)
    row = spark.sql("SELECT b.* FROM VALUES ('<title>T</title><h2>A</h2><p>x <b>y</b></p>z') p(html), LATERAL page_blocks(p.html) b").first()
    assert (row.title, row.loose, [tuple(b) for b in row.blocks]) == ("T", "z", [("h2", 2, "A"), ("p", 0, "x y")])
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM page_blocks(7)").collect()


def test_sections_of_markdown_run_no_python(spark):
    docs = spark.sql("SELECT * FROM VALUES (1, '# A') d(doc_id, text)")
    plan = S.sections(docs, S.MARKDOWN)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("EvalPython", "MapInArrow", "MapInPandas", "Exchange"))


def test_fences_of_two_kinds_and_many_headings(spark):
    many = "\n".join(f"{'#' * (1 + k % 6)} h{k}\ntext {k}" for k in range(1500))
    docs = spark.createDataFrame(
        [(1, "```\n# a\n~~~\n# b\n```\n# c\n```\n# d"), (2, many), (3, "~~~\n# a\n~~~\n## b\nx")], "doc_id int, text string"
    )
    rows = S.sections(docs, S.MARKDOWN).orderBy("doc_id", "section_index").collect()
    assert [(r.section_path, r.text) for r in rows if r.doc_id == 1] == [(["d"], "a\nb\nc")]
    path, want = [], []
    for k in range(1500):
        path = [*path[: k % 6], f"h{k}"]
        want.append((["h0", *path] if path[0] != "h0" else path, f"text {k}"))
    assert [(r.section_path, r.text) for r in rows if r.doc_id == 2] == want
    assert [(r.section_path, r.text) for r in rows if r.doc_id == 3] == [(["Untitled Document"], "a"), (["Untitled Document", "b"], "x")]


PAGES = "/root/testdata/sf0.001"


def test_page_sections_hold_all_text_of_blocks(spark):
    rows = Q.queries()["page_sections"](spark, PAGES).collect()
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{PAGES}/pages.parquet").collect()}
    assert {r.page_id for r in rows} <= set(pages) and len({r.page_id for r in rows}) > 0.9 * len(pages)
    for r in rows:
        html = " ".join(pages[r.page_id].split())
        assert r.text.strip() == r.text and r.end_offset - r.start_offset == len(r.text)
        first = r.text.split()[0]
        assert first in html


def test_entities_as_the_standard_library_resolves_them(spark):
    r = random.Random(1)
    names = list(html5)
    texts = ["&amp;amp; &notit; &ampx", "&#0;&#128;&#13;&#xD800;&#x110000;&#99999999999;&#xFDD0;&#x1F600;", "& &; &# &#x; &foo; a&b", "", None]
    some = lambda: r.choice(["&" + r.choice(names), "&" + r.choice(names)[:4], " x", "&", f"&#{r.randrange(1200000)};", f"&#x{r.randrange(70000):x}"])
    texts += ["".join(some() for _ in range(20)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescaped(F.col("t")).alias("t")).collect()
    assert [t for _, t in sorted(rows)] == [t and html.unescape(t) for t in texts]


def test_patterns_are_only_tried_on_texts_that_hold_their_marks(spark):
    from evidentia.functions import text as X
    from evidentia.operators import markdown, sectioning

    texts = [
        "", " ", "plain words", "a **b** _c_ `d` <e> \\f", "see [x](y) ![z](w)", "```py\ncode\n```", "~~~\nx\n~~~", "# head\n## two #",
        "1. one\n2. two\n- a\n+ b\n* c\n> d\n٣. e", "a \t b  c\u2003d , e\u3000.\n\n\n\nf\u00a0", "\u2028\u0085 x y \u1680\u001c", "x\r\ny\rz", "é ; ü\u202f!  ",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = lambda rules: tuple(r[:2] for r in rules)
    for rules in (markdown.BLOCK, markdown.INLINE):
        got = rows.select(sectioning.replaced(F.col("t"), rules).alias("a"), sectioning.replaced(F.col("t"), bare(rules)).alias("b")).collect()
        assert all(r.a == r.b for r in got)
    old = F.regexp_replace("t", rf"^[{X.WS}]+|[{X.WS}]+$", "")
    assert all(r.a == r.b for r in rows.select(X.stripped(F.col("t")).alias("a"), old.alias("b")).collect())
    plan = rows.select(markdown.block_text(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("contains") >= 12


def test_repaired_answers_are_made_once(spark):
    got, context = Q._answers(spark, "/root/testdata/sf0.001")
    fixed = A.repaired(A.validated(got, context, "answer_id"), "answer_id")
    plan = fixed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # a table, however often a later check reads it
