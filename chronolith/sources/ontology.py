"""An ontology read from Turtle, as statements and as the rules that inference and validation take.

Statements stay a table; rules are collected, as an ontology is part of the program: ``MOST`` statements at most."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.rdf import RDF, read_turtle

MOST = 100_000
# fixed values: namespaces of schemas
RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def load(spark: SparkSession, paths: list[str], graph: str = "ontology") -> tuple[DataFrame, DataFrame]:
    """(statements of one graph, texts that are none) of several files; statements that files share count once."""
    rows, bad = None, None
    for path in paths:
        good, wrong = read_turtle(spark, path, graph)
        rows = good if rows is None else rows.unionByName(good)
        bad = wrong if bad is None else bad.unionByName(wrong)
    return rows.distinct(), bad


def local_names(rows: DataFrame, spaces: list[str]) -> DataFrame:
    """Statements with IRIs of some namespaces cut to their local names, the names that typed tables use."""
    for c in ("s", "p", "o"):
        short = F.col(c)
        for space in sorted(spaces, key=len, reverse=True):
            short = F.when(F.col(c).startswith(space), F.substring(F.col(c), len(space) + 1, 1 << 30)).otherwise(short)
        rows = rows.withColumn(c, F.when(F.col("o_kind") != "literal", short).otherwise(F.col(c)) if c == "o" else short)
    return rows


class Rules:
    """What an ontology says, by kind of rule."""

    def __init__(self, ontology: DataFrame) -> None:
        self.spark = ontology.sparkSession
        rows = ontology.select("s", "p", "o", "o_kind").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"an ontology has {MOST} statements at most")
        self._of: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for r in rows:
            if r.o_kind != "literal":
                self._of[r.p].append((r.s, r.o))
        self._one = {(p, s): o for p, pairs in self._of.items() for s, o in pairs}

    def pairs(self, p: str) -> list[tuple[str, str]]:
        """Pairs of names that a property connects; nodes without a name are left out."""
        return sorted({(s, o) for s, o in self._of.get(p, []) if not s.startswith("_:") and not o.startswith("_:")})

    def of_type(self, kind: str) -> list[str]:
        return sorted(s for s, o in self.pairs(RDF + "type") if o == OWL + kind)

    def _list(self, node: str) -> list[str]:
        out: list[str] = []
        seen = set()
        while node and node != RDF + "nil" and node not in seen:
            seen.add(node)
            out.append(self._one.get((RDF + "first", node), ""))
            node = self._one.get((RDF + "rest", node), "")
        return [x for x in out if x and not x.startswith("_:")]

    def members(self, p: str) -> list[tuple[str, str]]:
        """(class, member) of ``unionOf`` or ``intersectionOf``, stated of a class or of what it is equivalent to."""
        same = defaultdict(set)
        for s, o in [*self._of.get(OWL + "equivalentClass", []), *((o, s) for s, o in self._of.get(OWL + "equivalentClass", []))]:
            same[o].add(s)
        out = set()
        for s, head in self._of.get(OWL + p, []):
            for name in ({s} | same[s]) if s.startswith("_:") else {s}:
                if not name.startswith("_:"):
                    out |= {(name, m) for m in self._list(head)}
        return sorted(out)

    def keys(self) -> list[list[str]]:
        return [self._list(head) for _, head in self._of.get(OWL + "hasKey", [])]

    def _both(self, p: str) -> set[tuple[str, str]]:
        own = self.pairs(p)
        return {*own, *((b, a) for a, b in own)}

    def hierarchy(self) -> list[tuple[str, str]]:
        """(class, wider class), equivalent classes both ways; closed by ``graph.closure_of_rules``."""
        return sorted({*self.pairs(RDFS + "subClassOf"), *self._both(OWL + "equivalentClass")})

    def for_inference(self) -> dict[str, object]:
        """Arguments of ``inference.reasoned``."""
        make = self.spark.createDataFrame
        pq, pc, cm = "p string, q string", "p string, class string", "class string, member string"
        return {
            "inverses": make(self.pairs(OWL + "inverseOf"), pq), "supers": make(sorted({*self.pairs(RDFS + "subPropertyOf"), *self._both(OWL + "equivalentProperty")}), pq), "symmetrics": self.of_type("SymmetricProperty"), "transitives": self.of_type("TransitiveProperty"),
            "functional": self.of_type("FunctionalProperty"), "inverse_functional": self.of_type("InverseFunctionalProperty"), "keys": self.keys(), "literals": self.of_type("DatatypeProperty"),
            "domains": make(self.pairs(RDFS + "domain"), pc), "ranges": make([x for x in self.pairs(RDFS + "range") if x[0] not in self.of_type("DatatypeProperty")], pc),
            "unions": make([*self.members("unionOf"), *((b, a) for a, b in self.hierarchy())], cm), "intersections": make(self.members("intersectionOf"), cm),
        }
