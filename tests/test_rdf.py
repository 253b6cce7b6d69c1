"""Statements as text: hand-made Turtle and N-Quads, escapes both ways, bad parts to quarantine, pieces of split files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolith.sources import rdf

XSD, RDF = rdf.XSD, rdf.RDF


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())
    return f"file://{folder}"


def plain(rows):
    """Rows without the file's mark in blank nodes."""
    short = lambda v: "_:" + v.split(".", 1)[1] if v and v.startswith("_:") else v
    return sorted(((short(r.s), r.p, short(r.o) if r.o_kind == "blank" else r.o, r.o_kind, r.o_lang, r.o_dtype) for r in rows), key=str)


TURTLE = r'''@prefix ex: <http://ex/> .
@prefix : <http://none/>.
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
@base <http://base/> .
# a comment. "with a quote
ex:a a ex:C ; ex:p "t\u00e9\U0001F600 \"q\" \\ \n" , 'x''' + "'" + r'''@FR-be, 5, -1.5, 2e3, true ;
  ex:q """long
text with a point.
and "quotes" in it.
""" ;
  ; .
<rel> :x_1 _:b1 . _:b1 ex:p "v"^^xsd:date, "w"^^xsd:string .
ex:l ex:list ( 1 [ ex:in "deep" ] ) .
[ ex:alone "yes" ] .
ex:half ex:p .
ex:z nope:p 1 .
ex:ok ex:p ex:a\,b, ex:c%20d, () .
ex:last ex:p <http://ex/\u0041#f>'''


def test_turtle(spark, tmp_path):
    good, bad = rdf.read_turtle(spark, put(tmp_path / "t", "a.ttl", TURTLE), "g1")
    rows = good.collect()
    found = plain(rows)
    e = "http://ex/"
    named = [r for r in found if not (r[0].startswith("_:") or r[2].startswith("_:")) or r[0] == "_:b1" or r[2] == "_:b1"]
    assert sorted(named, key=str) == sorted(
        [
            (e + "a", RDF + "type", e + "C", "uri", None, None), (e + "a", e + "p", 'té😀 "q" \\ \n', "literal", None, None), (e + "a", e + "p", "x", "literal", "fr-be", None),
            (e + "a", e + "p", "5", "literal", None, XSD + "integer"), (e + "a", e + "p", "-1.5", "literal", None, XSD + "decimal"), (e + "a", e + "p", "2e3", "literal", None, XSD + "double"), (e + "a", e + "p", "true", "literal", None, XSD + "boolean"),
            (e + "a", e + "q", 'long\ntext with a point.\nand "quotes" in it.\n', "literal", None, None), ("http://base/rel", "http://none/x_1", "_:b1", "blank", None, None), ("_:b1", e + "p", "v", "literal", None, XSD + "date"), ("_:b1", e + "p", "w", "literal", None, None),
            (e + "ok", e + "p", e + "a,b", "uri", None, None), (e + "ok", e + "p", e + "c%20d", "uri", None, None), (e + "ok", e + "p", RDF + "nil", "uri", None, None), (e + "last", e + "p", e + "A#f", "uri", None, None),
        ],
        key=str,
    )
    by_s = {}
    for r in rows:
        by_s.setdefault(r.s, {})[r.p] = r
    head = by_s[e + "l"][e + "list"].o
    assert by_s[head][RDF + "first"].o == "1" and by_s[by_s[head][RDF + "rest"].o][RDF + "rest"].o == RDF + "nil"
    inner = by_s[by_s[head][RDF + "rest"].o][RDF + "first"].o
    assert by_s[inner][e + "in"].o == "deep" and sum(r.p == e + "alone" for r in rows) == 1
    assert sorted((r.value.split()[0], bool(r.reason)) for r in bad.collect()) == [("ex:half", True), ("ex:z", True)]
    assert {r.g for r in rows} == {"g1"}


def test_turtle_in_many_pieces(spark, tmp_path):
    """Splits of a few bytes give what one split gives, also where texts of several lines lie across them."""
    lines = ["@prefix ex: <http://ex/> ."] + [f'ex:s{i} ex:p """line {i}.\nnext.\n""" ; ex:q "{i}" .' if i % 3 else f"ex:s{i} ex:p {i} ." for i in range(60)]
    place = put(tmp_path / "m", "a.ttl", "\n".join(lines) + "\n")
    put(tmp_path / "m", "b.ttl", "@prefix ex: <http://other/> .\nex:s ex:p ex:o .\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        good, bad = rdf.read_turtle(spark, place)
        got = plain(good.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("http://other/s", "http://other/p", "http://other/o", "uri", None, None)]
    for i in range(60):
        s, p = f"http://ex/s{i}", "http://ex/p"
        want += [(s, p, f"line {i}.\nnext.\n", "literal", None, None), (s, "http://ex/q", str(i), "literal", None, None)] if i % 3 else [(s, p, str(i), "literal", None, XSD + "integer")]
    assert got == sorted(want, key=str) and bad.collect() == []


ROWS = [
    ("http://ex/a", "http://ex/p", 'quote " back \\ line\n tab\t \x08\x0c\r é 😀 \\u0041', "literal", None, None, "http://ex/g"),
    ("http://ex/a", "http://ex/p", "", "literal", None, None, "http://ex/g"),
    ("http://ex/a", "http://ex/p", "ends with a point.\nand goes on.", "literal", "fr", None, None),
    ("http://ex/a", "http://ex/p", "5", "literal", None, XSD + "integer", None),
    ("http://ex/a b<c>", "http://ex/p-1", "http://ex/x^|`", "uri", None, None, "http://ex/g 1"),
    ("_:n1", "http://ex/p", "_:n2", "blank", None, None, "http://ex/g"),
    ("http://ex/é#1", "http://other/ns#a.b", "x" * 20_000 + "\n" * 9_000, "literal", None, None, None),
]
SCHEMA = "s string, p string, o string, o_kind string, o_lang string, o_dtype string, g string"


@pytest.mark.parametrize("syntax", ["n_quads", "turtle"])
def test_round_trip(spark, tmp_path, syntax):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    path = f"file://{tmp_path}/{syntax}"
    if syntax == "n_quads":
        rdf.write_n_quads(rows, path)
        good, bad = rdf.read_n_quads(spark, path)
        assert sorted(((r.g or "") for r in good.collect())) == sorted((r[6] or "") for r in ROWS)
    else:
        rdf.write_turtle(rows, path, {"ex": "http://ex/", "xsd": XSD})
        good, bad = rdf.read_turtle(spark, path)
    assert bad.collect() == [] and plain(good.collect()) == sorted((r[:6] for r in ROWS), key=str)


def test_n_quads_quarantine(spark, tmp_path):
    lines = ['<a:b> <a:c> "x" .', "# note", "", '<a:b> <a:c> "x" <a:g> . # said', "<a:b> <a:c> .", '<a:b> <a:c> "bad \\q escape" .', '<a:b> "no" <a:c> .', '<a:b> <a:c> "open .', '<a:b> <a:c> "two" "three" .', '<a:b><a:c>"tight"@en-GB.', '_:x.y <a:c> _:z <a:g>.', '<a:\\q> <a:c> "x" .']
    good, bad = rdf.read_n_quads(spark, put(tmp_path / "q", "a.nq", "\n".join(lines) + "\n"), "default")
    assert sorted((r.s.split(".", 1)[-1], r.o.split(".", 1)[-1], r.o_lang, r.g) for r in good.collect()) == sorted([("a:b", "x", None, "default"), ("a:b", "x", None, "a:g"), ("a:b", "tight", "en-gb", "default"), ("x.y", "z", None, "a:g")])
    assert sorted(r.value for r in bad.collect()) == sorted([lines[4], *lines[5:9], lines[11]])


def test_relabelled(spark, tmp_path):
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    source = put(tmp_path / "in", "a.ttl", f'<a:x> <{label}> "un"@fr, "one"@en ; <a:p> "un"@fr .\n')
    bad = rdf.relabelled(source, f"file://{tmp_path}/out", spark, "fr", F.upper)
    good, _ = rdf.read_turtle(spark, f"file://{tmp_path}/out")
    assert bad.collect() == [] and sorted((r.p, r.o, r.o_lang) for r in good.collect()) == [("a:p", "un", "fr"), (label, "UN", "fr"), (label, "one", "en")]
