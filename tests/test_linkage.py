import pytest
from pyspark.sql import functions as F

from querent.functions import markup, text
from querent.operators import fields, linkage


def one(spark, column, **values):
    kinds = {str: "string", int: "int", type(None): "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_variants(spark):
    v = linkage.title_variants(F.col("t"), F.col("y"), F.col("m"))
    assert one(spark, v, t=" The  One ", y=2010, m="film") == ["The One (2010 film)", "The One (film)", "The One"]
    assert one(spark, v, t="X", y=2010, m="tv")[0] == "X (2010 TV series)" and one(spark, v, t=" ", y=2010, m="tv") == []


@pytest.mark.parametrize(
    "title, said, asked, year, media, want",
    [
        ("One (2010 film)", "2010 film", "One (2010 film)", 2010, "film", ("high", "year_qualified_title")),
        ("One", "2010 film by A", "One", 2010, "film", ("high", "bare_title_desc_corroborated")),
        ("One (film)", "2011 film", "One (film)", 2010, "film", ("medium", "type_title_plus_desc_year")),
        ("One (2010 film)", "", "One (2010 TV series)", 2010, "tv", ("none", "type_mismatch:film")),
        ("One", "1950 film", "One", 2010, "film", ("none", "year_mismatch")),
        ("One", "film", "One", 2010, "film", ("low", "type_without_year_corroboration")),
        ("One", "village", "One", 2010, "film", ("none", "insufficient_evidence")),
        ("", "", "One", 2010, "film", ("none", "missing")),
    ],
)
def test_scores(spark, title, said, asked, year, media, want):
    page = F.struct(F.col("p").alias("title"), F.col("d").alias("description"), F.lit(False).alias("missing"), F.lit(False).alias("disambiguation"))
    got = one(spark, linkage.score(F.lit("One"), F.col("y"), F.col("m"), page, F.col("a")), p=title, d=said, a=asked, y=year, m=media)
    assert tuple(got) == want


def test_choice(spark):
    make = lambda *rows: linkage.choose(spark.createDataFrame([("s", *r) for r in rows], "show_id string, page_title string, confidence string")).first()
    assert make(("A", "high"), ("a", "medium"), ("B", "medium")).page_title == "A"
    assert make(("A", "high"), ("B", "high")).status == "ambiguous"
    assert make(("A", "low"), ("B", "none")).status == "not_found"


def test_markup(spark):
    raw = "== Plot ==\nA [[dog|cat]] ran{{cite|x {{y}}}}.<ref>r</ref> '''Then''' [https://a.b see] it.<!-- no -->\n\n\n\nEnd [[File:x.png|thumb]]"
    assert one(spark, markup.plain_text(F.col("w")), w=raw) == "A cat ran. Then see it.\n\nEnd"
    page = "intro\n== Cast ==\nX\n== Plot ==\n=== Act ===\nstory\n== Reception ==\nY"
    assert one(spark, markup.plot_section(F.col("w")), w=page)["name"] == "Plot"
    assert one(spark, markup.plot_section(F.col("w")), w="nothing") is None
    assert one(spark, markup.is_disambiguation(F.col("w")), w="x {{Disambig}}")


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Intro {{cite|a}} tail {{broken text } and the whole rest of the plot.", "Intro tail broken text } and the whole rest of the plot."),
        ("text {| never closed table and rest", "text {| never closed table and rest"),
        ("x \x01 y {{z}} w \x02", "x \x01 y w \x02"),
        ("[[File:x.jpg|thumb|a caption with [[link]] inside]]", "inside"),
        ("a {| b {{c|}} |} d", "a d"),
        ("{{a {b} c}} d", "a {b} c d"),
        ("a {{b {{c}} d}} e }} f", "a e f"),
        ("a {{never closed", "a"),
        ("[[a|b [[c]] d]] [[e]] [[f|]] ]]", "b c d e f|"),
        ("it's ''i'' and '''''b'''''", "it's i and b"),
        ("a <i>b</i><br/> c < d", "a b c < d"),
        ("x<ref name=a/> y <REF>z {{t}}</REF> w <!-- {{ -->v", "x y w v"),
        ("[https://a.b see this] [https://a.b] [note]", "see this [https://a.b] [note]"),
        ("a  \t b\t\n\n\n\n  c \n", "a b\n\n c"),
        ("\n == Plot ==\n\nstory", "story"),
        ("==\nno heading", "==\nno heading"),
        (None, ""),
        ("{{" * 3000 + "x", ""),
        ("{{" * 3000 + "x" + "}}" * 3000 + "y" + "]]" * 3000, "y"),
    ],
)
def test_scanner(raw, want):
    from querent.functions.wikitext import plain

    assert plain(raw) == want


def test_sections_and_headings(spark):
    from querent.functions.wikitext import plot, sections

    page = "lead\n==Cast==\nx\n== Synopsis <!-- c --> ==  \n=== Act ===\n[[a|b]]\n== End =="
    assert sections(page) == [("Cast", "x"), ("Synopsis", "=== Act ===\n[[a|b]]"), ("End", "")]
    assert plot(page)[1] == "b" and plot("== Plot ==\n{{x}}\n== Story ==\ny") == ("Story", "y") and plot(None) is None
    lines = spark.createDataFrame([([("1", "Overview", "2"), ("2", "Plot", "2"), ("3", "Cast", "2")],), ([("1", "Story and cast", "2"), ("2", "The plot", "2")],), ([("1", "Plot", "3")],)], "s array<struct<index:string,line:string,level:string>>")
    assert [r[0] and r[0]["index"] for r in lines.select(markup.best_heading(F.col("s"))).collect()] == ["2", "2", None]


def test_texts(spark):
    assert one(spark, text.highlight(F.col("t"), ["cat", "amp"]), t="Cat & concat <cat>") == "<mark>Cat</mark> &amp; concat &lt;<mark>cat</mark>&gt;"
    assert one(spark, text.truncate(F.col("t"), 20), t="One two three. Four five six") == "One two three."
    assert one(spark, text.truncate(F.col("t"), 10), t="abcdef ghijkl") == "abcdef…"
    assert one(spark, text.shorten(F.col("t"), 10), t="abc  defghi jkl") == "abc…"
    assert one(spark, text.year(F.col("t")), t="2019.0") == 2019 and one(spark, text.year(F.col("t")), t="x") is None
    assert one(spark, text.page_url(F.col("t")), t="A b/c?").endswith("/A_b/c%3F")


def test_fields(spark):
    c = spark.createDataFrame([("s1", " A ", None, "g", None)], "show_id string, title string, description string, listed_in string, director string")
    r = fields.text_fields(c).first()
    assert (r.title_text, r.text, r.text_meta, r.text_plot) == ("A", "A", "A  g", "A")
    with pytest.raises(ValueError):
        fields.text_fields(c.drop("title"))


def test_sources(spark, tmp_path):
    from querent import sources

    (tmp_path / "c.csv").write_text('show_id,title,description,type\ns1,NA,"two\nlines",Movie\ns2,B,"say ""x""",TV Show\n')
    (tmp_path / "p.jsonl").write_text('{"show_id":"s2","plot_text":"first","status":"matched"}\n\n{"show_id":"s2","plot_text":"later","status":"matched"}\n{"show_id":"s1","plot_text":"no","status":"ambiguous"}\n')
    got = {r.show_id: r for r in sources.load_catalog(spark, str(tmp_path / "c.csv"), str(tmp_path / "p.jsonl")).collect()}
    assert got["s1"].title == "" and got["s1"].text == "two\nlines" and got["s2"].text_plot == 'B say "x" first'
    assert sources.load_plots(spark, str(tmp_path / "absent.jsonl")).count() == 0
    assert sources.replace_block("a<!-- t:begin -->x<!-- t:end -->b", "t", "y") == "a<!-- t:begin -->\ny\n<!-- t:end -->b"
