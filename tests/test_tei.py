"""TEI shredding: mixed content order, refs, tables/figures, empty and malformed input."""

from scriptorium.sources.tei import SHREDDED_SCHEMA, shred_one, shred_tei, tei_sections

DOC = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt>'
    '<title level="a" type="main"> T &amp; x </title></titleStmt></fileDesc>'
    "<profileDesc><abstract><p>abs</p></abstract></profileDesc></teiHeader><text><body>"
    '<div xmlns="http://www.tei-c.org/ns/1.0"><head n="1.">Intro</head><p>alpha <ref type="bibr" target="#b1">[1]</ref> omega 1 end'
    '<ref type="figure" target="#f1"/></p><p></p></div><div xmlns="http://www.tei-c.org/ns/1.0"><p>  </p></div>'
    '<figure xml:id="fig1"><head>Figure 1</head><figDesc>cap</figDesc></figure>'
    '<figure type="table" xml:id="tab1"><head>Table 1</head><figDesc>tc</figDesc><table>'
    "<row><cell>Method</cell><cell>acc</cell></row><row><cell>ours</cell><cell>0.8</cell></row></table></figure>"
    "</body><back><listBibl><biblStruct><analytic><title>Ref one</title></analytic></biblStruct></listBibl></back></text></TEI>"
)


def test_mixed_content_keeps_order_and_refs():
    p = shred_one(DOC)
    assert p["title"] == "T & x" and p["abstract"] == "abs"
    assert len(p["sections"]) == 1  # the div with only blank text is skipped
    s = p["sections"][0]
    assert (s["heading"], s["num"], s["text"]) == ("Intro", "1.", "alpha [1] omega 1 end\n")
    assert s["publication_refs"] == ["b1"] and s["figure_refs"] == ["f1"] and s["table_refs"] == []
    assert p["tables"][0]["cells"] == [["Method", "acc"], ["ours", "0.8"]]
    assert p["figures"][0]["caption"] == "Figure 1cap" and p["references"] == ["Ref one"]


NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
WRAPPED = (
    f"<TEI {NS}><text><body>"
    f'<div {NS}><head n="1">Methods</head><p>one</p><div {NS}><head n="1.1">Inner</head><p>two</p></div></div>'
    '<figure xml:id="f0"><figDesc>no head</figDesc></figure><figure xml:id="f1"><label>7</label><figDesc>x</figDesc></figure>'
    '<figure type="table" xml:id="t0"><figDesc>bare</figDesc></figure></body><back>'
    f'<div type="acknowledgement"><div {NS}><head>Thanks</head><p>three</p></div></div>'
    '<div type="references"><listBibl><biblStruct><analytic><title>Ref</title></analytic></biblStruct></listBibl></div>'
    "</back></text></TEI>"
)


def test_only_divs_that_declare_the_namespace_are_sections():
    p = shred_one(WRAPPED)
    got = [(s["pos"], s["heading"], s["num"], s["text"]) for s in p["sections"]]
    # a nested section counts itself, and its text is part of its parent's; wrappers and references are no sections
    assert got == [(0, "Methods", "1", "one\n1.1Innertwo".replace("1.1", "")), (1, "Inner", "1.1", "two"), (2, "Thanks", "", "three")]
    assert p["references"] == ["Ref"]


def test_figures_without_head_take_their_label_or_none():
    p = shred_one(WRAPPED)
    assert [(f["label"], f["caption"], f["figure_id"]) for f in p["figures"]] == [("", "no head", "f0"), ("7", "7x", "f1")]
    assert p["tables"] == [{"pos": 0, "label": "", "figure_id": "t0", "type": "table", "caption": "bare", "cells": []}]


def test_empty_and_malformed_give_empty_papers():
    for content in (None, "", "   "):
        p = shred_one(content)
        assert p["sections"] == [] and p["error"] is None
    bad = shred_one("<TEI><text>")
    assert bad["sections"] == [] and bad["error"].startswith("ParseError")


def test_shred_in_spark(spark):
    df = spark.createDataFrame([(1, DOC), (2, ""), (3, "<oops")], "item_key long, content string")
    out = shred_tei(df)
    assert out.schema.simpleString().startswith("struct<item_key:bigint")
    assert "sections" in SHREDDED_SCHEMA
    rows = {r.item_key: r for r in out.collect()}
    assert rows[2].title == "" and rows[3].error is not None
    assert [r.heading for r in tei_sections(out).collect()] == ["Intro"]
