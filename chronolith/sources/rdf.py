"""Statements as text: N-Quads and Turtle, both ways.

A statement is a row (s, p, o, o_kind, o_lang, o_dtype, g): ``o_kind`` is uri, blank or literal; blank nodes are texts
that start with ``_:``; plain texts have neither language nor datatype.  Files are read by Spark's text source, so they
may lie wherever Spark reads, and are split: N-Quads by lines, Turtle by the ends of statements.  What can't be read
goes to a second table (file, value, reason) and nowhere else.

Labels of blank nodes belong to their file: they are read as ``_:<digest of the file's name>.<label>``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators.rounds import settled

COLUMNS = ["s", "p", "o", "o_kind", "o_lang", "o_dtype", "g"]
# fixed values: terms of the syntaxes
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_ESCAPE = r"\\[tbnrf\"'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI, _BLANK = r'<[^\x00-\x20<>"{}|^`]*>', r"_:[0-9\p{L}_](?:[\p{L}\p{N}_.·-]*[\p{L}\p{N}_·-])?"
_LINE = rf'^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*(?:({_IRI}|{_BLANK})|"(.*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^({_IRI}))?)\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$'


def unescaped(text: Column) -> Column:
    """A literal's or IRI's text with its escapes read."""
    piece = F.regexp_extract_all(text, F.lit(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|" + _ESCAPE + r"|[^\\]+|\\"), F.lit(0))
    digits = lambda v: F.unhex(F.regexp_replace(F.substring(v, 2, 12), r"[uU\\]", ""))

    def read(v: Column) -> Column:
        kind = F.substring(v, 1, 2)
        short = F.create_map(*[F.lit(x) for pair in {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': '"', "\\'": "'", "\\\\": "\\"}.items() for x in pair])
        return F.when(kind == "\\U", F.decode(digits(v), "UTF-32")).when(kind == "\\u", F.decode(digits(v), "UTF-16BE")).otherwise(F.coalesce(F.try_element_at(short, v), v))

    return F.when(text.contains("\\"), F.array_join(F.transform(piece, read), "")).otherwise(text)


def escaped(text: Column) -> Column:
    """A text as the inside of a quoted literal."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _file_mark(file: Column) -> Column:
    return F.substring(F.md5(file), 1, 12)


def _node(term: Column, file: Column) -> Column:
    """The text of an IRI without its brackets, or of a blank node with its file."""
    return F.when(term.startswith("<"), unescaped(F.substring(term, 2, 1 << 30).substr(F.lit(1), F.length(term) - 2))).otherwise(F.concat(F.lit("_:"), _file_mark(file), F.lit("."), F.substring(term, 3, 1 << 30)))


def read_n_quads(spark: SparkSession, path: str, graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, lines that are none); lines without a graph are of ``graph``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    part = lambda k: F.nullif(F.regexp_extract("value", _LINE, k), F.lit(""))
    own = lines.select("value", "file", part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.regexp_extract("value", _LINE, 4).alias("d"), part(5).alias("e"), part(6).alias("f"), part(7).alias("h"))
    body = F.regexp_replace("d", _ESCAPE, "")
    fine = F.col("a").isNotNull() & ~body.contains('"') & ~body.contains("\\") & ~F.coalesce(F.concat_ws("", "a", "b", "c", "f", "h").rlike(r"\\(?!u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"), F.lit(False))
    kind = F.when(F.col("c").isNull(), "literal").when(F.col("c").startswith("<"), "uri").otherwise("blank")
    file = F.col("file")
    rows = own.where(fine).select(
        _node(F.col("a"), file).alias("s"), _node(F.col("b"), file).alias("p"), F.when(F.col("c").isNull(), unescaped(F.col("d"))).otherwise(_node(F.col("c"), file)).alias("o"), kind.alias("o_kind"), F.lower("e").alias("o_lang"),
        F.when(F.col("f").isNotNull() & (F.col("f") != f"<{XSD}string>"), _node(F.col("f"), file)).alias("o_dtype"), F.coalesce(F.when(F.col("h").isNotNull(), _node(F.col("h"), file)), F.lit(graph)).alias("g"),
    )
    reason = F.when(F.col("a").isNull(), "no statement").otherwise("bad escape or quote")
    return rows, own.where(~fine).select("file", "value", reason.alias("reason"))


def _term(node: Column) -> Column:
    """An IRI in brackets, or a blank node with a label that every reader takes."""
    odd = F.regexp_replace(F.substring(node, 3, 1 << 30), r"[^0-9A-Za-z_.-]", "_")
    safe = node
    for c in '\\<>"{}|^`':
        safe = F.replace(safe, F.lit(c), F.lit(f"\\u{ord(c):04X}"))
    safe = F.replace(F.replace(F.replace(safe, F.lit(" "), F.lit("\\u0020")), F.lit("\n"), F.lit("\\u000A")), F.lit("\t"), F.lit("\\u0009"))
    return F.when(node.startswith("_:"), F.concat(F.lit("_:"), F.regexp_replace(odd, r"^[.-]|[.]$", "_"))).otherwise(F.concat(F.lit("<"), safe, F.lit(">")))


def _literal(datatype: Column) -> Column:
    return F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^"), datatype)).otherwise(F.lit("")))


def n_quad_lines(rows: DataFrame) -> DataFrame:
    """A line (value) for each statement; without a graph, a line of N-Triples."""
    o = F.when(F.col("o_kind") == "literal", _literal(_term(F.col("o_dtype")))).otherwise(_term(F.col("o")))
    return rows.select(F.concat_ws(" ", _term(F.col("s")), _term(F.col("p")), o, F.when(F.col("g").isNotNull(), _term(F.col("g"))), F.lit(".")).alias("value"))


def write_n_quads(rows: DataFrame, path: str) -> None:
    n_quad_lines(rows).write.text(path)


def _named(node: Column, prefixes: dict[str, str]) -> Column:
    """An IRI by the first prefix that fits, where the rest is a plain local name; else in brackets."""
    out = None
    for name, space in prefixes.items():
        rest = F.substring(node, len(space) + 1, 1 << 30)
        fits = node.startswith(space) & rest.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$")
        text = F.concat(F.lit(f"{name}:"), rest)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return _term(node) if out is None else out.otherwise(_term(node))


def write_turtle(rows: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Statements as Turtle, one to a line and those of a subject together, each file with its prefixes; graphs aren't written.

    A statement a line keeps a subject with very many statements out of one row, and lets readers split files."""
    own = prefixes or {}
    node = lambda c: _named(F.col(c), own)
    o = F.when(F.col("o_kind") == "literal", _literal(node("o_dtype"))).otherwise(node("o"))
    lines = rows.select("s", F.concat_ws(" ", node("s"), node("p"), o, F.lit(".")).alias("value"))
    head = [f"@prefix {name}: <{space}> ." for name, space in own.items()]

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and head and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], schema=batch.schema)
                first = False
            yield batch

    # by ranges, so that a subject with very many statements spreads over files
    lines.repartitionByRange(F.col("s"), F.col("value")).sortWithinPartitions("s", "value").select("value").mapInArrow(with_head, "value string").write.text(path)


# --- Turtle ------------------------------------------------------------------------------------------------------

_NAME = r"[^\W\d_](?:[\w.·-]*[\w·-])?"
_TOKENS = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<text>\"{3}(?:(?:\"{1,2})?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'{1,2})?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.·-]*[\w·-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w.:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_READ = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)


class BadTurtle(ValueError):
    """A text that is no Turtle."""


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3] is None:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _SHORT:
            raise BadTurtle(f"escape \\{m[3]}")
        return _SHORT[m[3]]

    out = _READ.sub(one, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16") if any("\ud800" <= c < "\ue000" for c in out) else out


def directives(text: str) -> tuple[dict[str, str], str | None]:
    """Prefixes and base of the statements ``@prefix`` and ``@base`` (or PREFIX, BASE) in a text."""
    found = {m[1]: _plain(m[2]) for m in re.finditer(r"(?im)(?:^|\.)\s*@?prefix\s+([^\s:]*):\s*<([^<>\s]*)>", text)}
    base = re.findall(r"(?im)(?:^|\.)\s*@?base\s+<([^<>\s]*)>", text)
    return found, base[-1] if base else None


class Turtle:
    """Reads texts of whole statements under given prefixes."""

    def __init__(self, prefixes: dict[str, str], base: str | None, mark: str) -> None:
        self.prefixes, self.base, self.mark = prefixes, base, mark

    def statements(self, text: str, place: str) -> tuple[list[tuple], list[tuple[str, str]]]:
        """Rows (s, p, o, o_kind, o_lang, o_dtype), and statements that can't be read with the reason."""
        rows: list[tuple] = []
        bad: list[tuple[str, str]] = []
        own: list[tuple[str, str, int, int]] = []
        at, depth = 0, 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                end = text.find(".\n", at)  # what follows the next end of a statement may be whole again
                end = len(text) if end < 0 else end + 2
                bad.append((text[own[0][2] if own else at : end].strip(), f"no token at {text[at : at + 20]!r}"))
                own, depth, at = [], 0, end
                continue
            at = m.end()
            kind = m.lastgroup
            if kind == "space":
                continue
            token = m[0]
            if kind == "mark" and token == "." and not depth:
                self._whole(own, text, place, rows, bad)
                own = []
                continue
            depth += (token in "([") - (token in ")]") if kind == "mark" else 0
            own.append((kind, token, m.start(), m.end()))
            if kind == "iri" and len(own) in (2, 3) and own[0][1].lower() in ("prefix", "base") and own[0][0] == "word":
                own = []  # PREFIX and BASE end without a mark
        if own:
            self._whole(own, text, place, rows, bad)
        return rows, bad

    def _whole(self, own: list, text: str, place: str, rows: list, bad: list) -> None:
        if not own or own[0][0] == "directive":
            return
        self.tokens, self.k, self.out = own, 0, []
        self.place, self.made = f"{place}.{own[0][2]}", 0
        try:
            self._triples()
            rows += self.out
        except (BadTurtle, IndexError) as e:
            bad.append((text[own[0][2] : own[-1][3]], str(e) or "breaks off"))

    def _next(self) -> tuple[str, str]:
        kind, token, *_ = self.tokens[self.k]
        self.k += 1
        return kind, token

    def _peek(self) -> str:
        return self.tokens[self.k][1] if self.k < len(self.tokens) and self.tokens[self.k][0] == "mark" else ""

    def _fresh(self) -> str:
        self.made += 1
        return f"_:{self.mark}.{hashlib.md5(f'{self.place}.{self.made}'.encode()).hexdigest()[:16]}"

    def _iri(self, kind: str, token: str) -> str:
        if kind == "iri":
            iri = _plain(token[1:-1])
            if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
                return self.base + iri if not iri.startswith("#") else self.base.split("#")[0] + iri
            return iri
        if kind == "name":
            name, local = token.split(":", 1)
            if name not in self.prefixes:
                raise BadTurtle(f"no prefix {name}:")
            return self.prefixes[name] + re.sub(r"\\(.)", r"\1", local)
        raise BadTurtle(f"no IRI: {token}")

    def _triples(self) -> None:
        alone = self._peek() == "["
        s, _ = self._resource()
        if self.k == len(self.tokens) and alone:
            return  # a list of properties of a node without a name is a statement by itself
        self._properties(s, "")
        if self.k != len(self.tokens):
            raise BadTurtle(f"left over: {self.tokens[self.k][1]}")

    def _resource(self) -> tuple[str, str]:
        """The next subject or object that is no literal, with its kind."""
        kind, token = self._next()
        if token == "[" and kind == "mark":
            node = self._fresh()
            if self._peek() != "]":
                self._properties(node, "]")
            if self._next()[1] != "]":
                raise BadTurtle("no ]")
            return node, "blank"
        if token == "(" and kind == "mark":
            items = []
            while self._peek() != ")":
                items.append(self._object())
            self._next()
            nodes = [self._fresh() for _ in items]
            for k, (o, o_kind, lang, dtype) in enumerate(items):
                self.out.append((nodes[k], RDF + "first", o, o_kind, lang, dtype))
                last = k + 1 == len(items)
                self.out.append((nodes[k], RDF + "rest", RDF + "nil" if last else nodes[k + 1], "uri" if last else "blank", None, None))
            return (nodes[0], "blank") if nodes else (RDF + "nil", "uri")
        if kind == "blank":
            return f"_:{self.mark}.{token[2:]}", "blank"
        return self._iri(kind, token), "uri"

    def _object(self) -> tuple[str, str, str | None, str | None]:
        kind, token = self.tokens[self.k][:2]
        if kind == "text":
            self.k += 1
            size = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
            value, lang, dtype = _plain(token[size:-size]), None, None
            if self.k < len(self.tokens) and self.tokens[self.k][0] == "lang":
                lang = self._next()[1][1:].lower()
            elif self.k < len(self.tokens) and self.tokens[self.k][0] == "type":
                self.k += 1
                dtype = self._iri(*self._next())
            return value, "literal", lang, None if dtype == XSD + "string" else dtype
        if kind == "number":
            self.k += 1
            return token, "literal", None, XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer")
        if kind == "word" and token in ("true", "false"):
            self.k += 1
            return token, "literal", None, XSD + "boolean"
        return (*self._resource(), None, None)

    def _properties(self, s: str, end: str) -> None:
        while True:
            kind, token = self._next()
            p = RDF + "type" if (kind, token) == ("word", "a") else self._iri(kind, token)
            while True:
                self.out.append((s, p, *self._object()))
                if self._peek() != ",":
                    break
                self.k += 1
            if self._peek() != ";":
                return
            while self._peek() == ";":
                self.k += 1
            if self.k == len(self.tokens) or (end and self._peek() == end):
                return


_PARSED = "s string, p string, o string, o_kind string, o_lang string, o_dtype string, value string, reason string, file string"


def read_turtle(spark: SparkSession, path: str, graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, texts that are none).

    A file is split where a line ends with a point, which ends a statement unless it lies in a text of several lines;
    pieces of such a text are put together again.  Prefixes are read first, and hold for their whole file: a file that
    gives a prefix twice is read with its last meaning."""
    raw = spark.read.option("lineSep", ".\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    raw = settled(raw.where(F.col("value") != ""), "turtle")
    # a mark of three quotes that isn't closed: what follows belongs to it
    open_ = F.pmod(F.regexp_count(F.regexp_replace("value", r"\\.", ""), F.lit('"""|\'\'\'')), F.lit(2))
    odd = raw.withColumn("__odd", open_)
    broken = odd.where("__odd = 1").select(F.col("file").alias("__file")).distinct()
    # only keys and counts go through the windows of a file; its texts meet the result afterwards
    keys = odd.join(broken, F.col("file") == F.col("__file"), "left_semi").select("file", "block", "row", "__odd")
    order = Window.partitionBy("file").orderBy("block", "row")
    keys = keys.withColumn("__before", F.coalesce(F.sum("__odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = F.pmod("__before", F.lit(2)) == 0  # not within a text
    keys = keys.withColumn("__part", F.sum(F.when(starts, 1).otherwise(0)).over(order)).select(F.col("file").alias("__f"), F.col("block").alias("__b"), F.col("row").alias("__r"), "__part")
    mend = odd.join(keys, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")) & (F.col("row") == F.col("__r")))
    mended = mend.groupBy("file", "__part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda v: v["value"]), ".\n").alias("value"), F.min("block").alias("block"), F.min("row").alias("row"))
    whole = odd.join(broken, F.col("file") == F.col("__file"), "left_anti").select("file", "value", "block", "row").unionByName(mended.select("file", "value", "block", "row"))
    said = raw.where(F.lower("value").rlike(r"(?m)(?:^|\.)\s*@?(?:prefix|base)\s")).select("file", "value", "block", "row")
    heads = said.groupBy(F.col("file").alias("__file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda v: F.array_join(F.regexp_extract_all(v["value"], F.lit(r"(?im)(?:^|\.)\s*@?(?:prefix\s+[^\s:]*:|base)\s*<[^<>\s]*>"), F.lit(0)), "\n")), "\n").alias("head"))
    rows = whole.join(heads, F.col("file") == F.col("__file"), "left").select("file", F.md5("file").substr(1, 12).alias("mark"), "head", "value", F.concat_ws(".", "block", "row").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Turtle] = {}
        names = [x.split()[0] for x in _PARSED.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                key = (r["file"], r["head"])
                if key not in known:
                    known.clear()  # rows of one file mostly follow one another
                    known[key] = Turtle(*directives(r["head"] or ""), r["mark"])
                good, bad = known[key].statements(r["value"], r["place"])
                out += [(*x, None, None, r["file"]) for x in good] + [(*[None] * 6, value, reason, r["file"]) for value, reason in bad]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=names)

    got = settled(rows.mapInArrow(run, _PARSED), "turtle-rows")
    good = got.where("reason is null").select("s", "p", "o", "o_kind", "o_lang", "o_dtype", F.lit(graph).alias("g"))
    return good, got.where("reason is not null").select("file", "value", "reason")


def relabelled(path_in: str, path_out: str, spark: SparkSession, lang: str, rewrite, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A Turtle file with the labels of a language rewritten by a function of a column; returns what couldn't be read."""
    rows, bad = read_turtle(spark, path_in)
    label = F.col("p").isin("http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel")
    mine = (F.col("o_kind") == "literal") & (F.col("o_lang") == lang)
    write_turtle(rows.withColumn("o", F.when(label & mine, rewrite(F.col("o"))).otherwise(F.col("o"))), path_out, prefixes)
    return bad
