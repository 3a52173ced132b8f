"""TEI full texts: shred into title/abstract/sections/tables/figures, and build.

A section is a ``div`` inside ``text`` that carries the TEI namespace
declaration itself; wrapper divs (acknowledgements, annexes, the list of
references) do not carry one and are no sections, though their children may be.

Shredding needs an XML parser that keeps mixed content in order, walks a
variable number of nested ``div`` elements and reports namespace declarations,
which neither the XML data source nor ``xpath_*`` can do; it runs in a Python
function of one paper's text (stdlib pull parser).  Spark hands such functions
100 rows at a time, where an Arrow batch holds up to 10,000 whole papers.
Everything after it is plain DataFrame work on the exploded children.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the TEI namespace.
TEI_NS = "http://www.tei-c.org/ns/1.0"
# Reference kinds (ref/@type) and the lists they go to.
REF_KINDS = {"bibr": "publication_refs", "figure": "figure_refs", "table": "table_refs"}

SECTION_STRUCT = (
    "struct<pos:int, heading:string, num:string, text:string, "
    "publication_refs:array<string>, figure_refs:array<string>, table_refs:array<string>>"
)
TABLE_STRUCT = "struct<pos:int, label:string, caption:string, figure_id:string, cells:array<array<string>>>"
FIGURE_STRUCT = "struct<pos:int, label:string, caption:string, type:string, figure_id:string>"
SHREDDED_SCHEMA = (
    f"title string, abstract string, sections array<{SECTION_STRUCT}>, "
    f"tables array<{TABLE_STRUCT}>, figures array<{FIGURE_STRUCT}>, references array<string>, "
    "formulas array<string>, error string"
)


# --- shredding (runs inside the Python worker) -----------------------------------

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _text(el) -> str:
    return "" if el is None else "".join(el.itertext())


def _all(el, name):
    return [e for e in el.iter() if _local(e.tag) == name] if el is not None else []


def _first(el, name, **attrs):
    return next((e for e in _all(el, name) if all(e.get(k) == v for k, v in attrs.items())), None)


def parse_tei(content: str) -> tuple[ET.Element, list[ET.Element]]:
    """(root, the divs that declare the TEI namespace themselves, in document order)."""
    parser = ET.XMLPullParser(events=("start-ns", "start"))
    parser.feed(content)
    parser.close()
    root, divs, declared = None, [], False
    for event, value in parser.read_events():
        if event == "start-ns":  # comes right before the start of the element that declares it
            declared = declared or value[1] == TEI_NS
            continue
        if root is None:
            root = value
        if declared and _local(value.tag) == "div":
            divs.append(value)
        declared = False
    return root, divs


def _pieces(div: ET.Element) -> tuple[ET.Element | None, list[str]]:
    """(head, stripped texts of the other children) of a div; blank text between children is no child."""
    nodes: list = [div.text] if div.text and div.text.strip() else []
    for child in div:
        nodes.append(child)
        if child.tail and child.tail.strip():
            nodes.append(child.tail)
    head = nodes.pop(0) if nodes and not isinstance(nodes[0], str) and _local(nodes[0].tag) == "head" else None
    return head, [(n if isinstance(n, str) else _text(n)).strip() for n in nodes]


def _section(div: ET.Element) -> dict | None:
    head, texts = _pieces(div)
    found = {"heading": _text(head), "num": "" if head is None else head.get("n", ""), "text": "\n".join(texts)}
    if not found["heading"] and not found["text"]:
        return None
    targets = [(ref.get("type"), ref.get("target")) for ref in _all(div, "ref") if ref.get("target") is not None]
    return found | {name: [t.lstrip("#") for kind_, t in targets if kind_ == kind] for kind, name in REF_KINDS.items()}


def _figure_fields(fig: ET.Element) -> dict:
    """Label (head, else label, else ""), id and kind of a figure element; its own label only."""
    titles = _all(fig, "head") or _all(fig, "label")
    return {
        "label": _text(titles[0]) if titles else "",
        "figure_id": fig.get(XML_ID) or "",
        "type": fig.get("type") or "figure",
    }


def _table(fig: ET.Element) -> dict:
    cells = [[_text(cell) for cell in _all(row, "cell")] for row in _all(_first(fig, "table"), "row")]
    return _figure_fields(fig) | {"caption": _text(_first(fig, "figDesc")), "cells": cells}


def _numbered(items: list[dict]) -> list[dict]:
    return [{"pos": pos, **item} for pos, item in enumerate(items)]


def shred_one(content: str | None) -> dict:
    """Parse one TEI document.  Empty content gives an empty paper; malformed
    XML gives an empty paper with ``error`` set."""
    paper = {"title": "", "abstract": "", "sections": [], "tables": [], "figures": [], "references": [], "formulas": [], "error": None}
    if content is None or not content.strip():
        return paper
    try:
        root, divs = parse_tei(content)
    except ET.ParseError as e:
        return {**paper, "error": f"ParseError: {e}"}
    inside = set(map(id, _all(_first(root, "text"), "div")))
    abstract = _first(root, "abstract")
    paragraphs = [_text(p).strip() for p in _all(abstract, "p")]
    figures = _all(root, "figure")
    return paper | {
        "title": _text(_first(root, "title", type="main")).strip(),
        "abstract": " ".join(paragraphs) if paragraphs else _text(abstract).strip(),
        "sections": _numbered([s for s in (_section(d) for d in divs if id(d) in inside) if s is not None]),
        "tables": _numbered([_table(f) for f in figures if f.get("type") == "table"]),
        "figures": _numbered([_figure_fields(f) | {"caption": _text(f)} for f in figures if f.get("type") != "table"]),
        "references": [_text(_first(bib, "title")).strip() for bib in _all(root, "biblStruct")],
        "formulas": [_text(f).strip() for f in _all(root, "formula")],
    }


def shred_tei(tei: DataFrame) -> DataFrame:
    """``item_key, content`` -> one row per paper with nested sections, tables,
    figures, references and formulas (see ``SHREDDED_SCHEMA``)."""
    from scriptorium.session import ship_package

    ship_package(tei.sparkSession)
    # not deterministic to the planner: a filter on a part of the paper does not parse it twice
    shred = F.udf(shred_one, SHREDDED_SCHEMA, useArrow=False).asNondeterministic()
    return tei.select("item_key", shred("content").alias("paper")).select("item_key", "paper.*")


def tei_sections(shredded: DataFrame) -> DataFrame:
    s = shredded.select("item_key", F.explode("sections").alias("s"))
    return s.select("item_key", "s.*")


def tei_tables(shredded: DataFrame) -> DataFrame:
    return shredded.select("item_key", F.explode("tables").alias("t")).select("item_key", "t.*")


def tei_figures(shredded: DataFrame) -> DataFrame:
    return shredded.select("item_key", F.explode("figures").alias("f")).select("item_key", "f.*")


# --- building TEI with column expressions ----------------------------------------

# Characters XML 1.0 cannot carry, and the escapes used.
XML_INVALID = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def xml_escape(c: Column) -> Column:
    c = F.regexp_replace(c, XML_INVALID, "")
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


def _refs_xml(col: str, kind: str) -> Column:
    return F.array_join(
        F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")),
                    lambda r: F.concat(F.lit(f'<ref type="{kind}" target="#'), xml_escape(r), F.lit('"/>'))),
        "",
    )


def section_div(heading: Column, num: Column, text: Column) -> Column:
    """``<div xmlns=..>`` of one section: ``<head n=..>`` (when heading or num is set) and one ``<p>``."""
    head = F.when(
        (heading != "") | (num != ""),
        F.concat(F.lit('<head n="'), xml_escape(num), F.lit('">'), xml_escape(heading), F.lit("</head>")),
    ).otherwise(F.lit(""))
    refs = F.concat(*[_refs_xml(c, k) for k, c in REF_KINDS.items()])
    return F.concat(F.lit(f'<div xmlns="{TEI_NS}">'), head, F.lit("<p>"), xml_escape(text), refs, F.lit("</p></div>"))


def _ordered(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), "")


def _head(label: Column) -> Column:
    return F.when(label != "", F.concat(F.lit("<head>"), xml_escape(label), F.lit("</head>"))).otherwise(F.lit(""))


def build_tei(
    papers: DataFrame, sections: DataFrame, tables: DataFrame, figures: DataFrame, annex_col: str | None = None
) -> DataFrame:
    """``item_key, content``: a TEI document per paper.

    ``papers``: item_key, title, abstract, and optionally ``references`` and
    ``formulas`` (arrays of strings).  Sections where ``annex_col`` is true stand
    in a wrapper div without namespace declaration; references stand in the back
    matter inside one.  Children are stacked and reduced with one aggregate
    keyed by paper.
    """

    def part(df: DataFrame, kind: int, pos: Column, xml: Column) -> DataFrame:
        return df.select("item_key", F.lit(kind).alias("_k"), pos.cast("int").alias("_p"), xml.alias("_x"))

    def each(items: Column, before: str, after: str) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), xml_escape(F.coalesce(x, F.lit(""))), F.lit(after))), "")

    div = section_div(F.col("heading"), F.col("num"), F.col("text"))
    if annex_col:
        div = F.when(F.col(annex_col), F.concat(F.lit('<div type="annex">'), div, F.lit("</div>"))).otherwise(div)
    sec = part(sections, 1, F.col("pos"), div)
    rows_xml = F.array_join(F.transform("cells", lambda r: F.concat(F.lit("<row>"), each(r, "<cell>", "</cell>"), F.lit("</row>"))), "")
    caption = F.concat(F.lit("<figDesc>"), xml_escape(F.col("caption")), F.lit("</figDesc>"))
    tab = part(tables, 2, F.col("pos"), F.concat(
        F.lit('<figure type="table" xml:id="'), xml_escape(F.col("figure_id")), F.lit('">'), _head(F.col("label")), caption,
        F.lit("<table>"), rows_xml, F.lit("</table></figure>")))
    fig = part(figures, 3, F.col("pos"), F.concat(
        F.lit('<figure xml:id="'), xml_escape(F.col("figure_id")), F.lit('">'), _head(F.col("label")), caption, F.lit("</figure>")))
    top = part(papers, 0, F.lit(0), F.concat(
        F.lit('<teiHeader><fileDesc><titleStmt><title level="a" type="main">'), xml_escape(F.coalesce("title", F.lit(""))),
        F.lit("</title></titleStmt></fileDesc><profileDesc><abstract><p>"), xml_escape(F.coalesce("abstract", F.lit(""))),
        F.lit("</p></abstract></profileDesc></teiHeader>")))
    parts = [top, sec, tab, fig]
    if "formulas" in papers.columns:
        parts.append(part(papers, 4, F.lit(0), each(F.col("formulas"), "<formula>", "</formula>")))
    if "references" in papers.columns:
        cited = each(F.col("references"), '<biblStruct><analytic><title level="a">', "</title></analytic></biblStruct>")
        parts.append(part(papers, 5, F.lit(0), F.concat(F.lit('<div type="references"><listBibl>'), cited, F.lit("</listBibl></div>"))))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)

    def gathered(kind: int) -> Column:
        return _ordered(F.collect_list(F.when(F.col("_k") == kind, F.struct(F.col("_p").alias("p"), F.col("_x").alias("v")))))

    agg = rows.groupBy("item_key").agg(*[gathered(k).alias(f"_{k}") for k in range(6)])
    content = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="{TEI_NS}">'), F.col("_0"),
        F.lit("<text><body>"), F.col("_1"), F.col("_4"), F.col("_3"), F.col("_2"), F.lit("</body><back>"), F.col("_5"), F.lit("</back></text></TEI>"),
    )
    return agg.select("item_key", content.alias("content"))
