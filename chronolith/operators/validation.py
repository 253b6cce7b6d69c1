"""Checks of statements (s, p, o, o_kind, o_dtype) and instances (s, class) against rules, and shapes compiled to them.

Rules are few rows and broadcast by name: Spark knows no size of rows that a driver made, and a join on so few classes or
predicates would put a third of all rows into one task.  Each check is one join or one group over the statements it concerns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.rounds import settled


def classes_of(instances: DataFrame, closure: DataFrame) -> DataFrame:
    """(s, class) with all superclasses."""
    c = closure.select(F.col("child").alias("__c"), F.col("parent").alias("__p"))
    return instances.join(F.broadcast(c), F.col("class") == F.col("__c"), "left").select("s", F.coalesce("__p", "class").alias("class")).distinct()


def domain_violations(quads: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """Subjects of rules' (p, class) that lack the class."""
    r = rules.select(F.col("p").alias("__p"), F.col("class").alias("__class"))
    used = quads.join(F.broadcast(r), F.col("p") == F.col("__p")).select("s", "p", "__class").distinct()
    c = classes.select(F.col("s").alias("__s"), F.col("class").alias("__c"))
    return used.join(c, (F.col("s") == F.col("__s")) & (F.col("__class") == F.col("__c")), "left_anti").select("s", "p", F.col("__class").alias("expected"))


def range_violations(quads: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects that aren't of a rule's (p, class, dtype) class, for resources, or datatype, for literals."""
    r = rules.select(F.col("p").alias("__p"), F.col("class").alias("__class"), F.col("dtype").alias("__dtype"))
    used = quads.join(F.broadcast(r), F.col("p") == F.col("__p"))
    literals = used.where("__dtype is not null and (o_kind <> 'literal' or not (o_dtype <=> __dtype))").select("s", "p", "o", F.col("__dtype").alias("expected"))
    c = classes.select(F.col("s").alias("__s"), F.col("class").alias("__c"))
    resources = used.where("__class is not null").join(c, (F.col("o") == F.col("__s")) & (F.col("__class") == F.col("__c")) & (F.col("o_kind") == "uri"), "left_anti").select("s", "p", "o", F.col("__class").alias("expected"))
    return literals.unionByName(resources).distinct()


def cardinality_violations(quads: DataFrame, predicate: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """(s, n) of subjects that have the predicate, but too seldom or too often."""
    n = quads.where(F.col("p") == predicate).groupBy("s").agg(F.count_distinct("o").alias("n"))
    wrong = F.lit(False)
    wrong = wrong if least is None else wrong | (F.col("n") < least)
    wrong = wrong if most is None else wrong | (F.col("n") > most)
    return n.where(wrong)


def functional_violations(quads: DataFrame, predicate: str, inverse: bool = False) -> DataFrame:
    """(node, n): subjects with several objects, or objects with several subjects."""
    one, many = ("o", "s") if inverse else ("s", "o")
    return quads.where(F.col("p") == predicate).groupBy(F.col(one).alias("node")).agg(F.count_distinct(many).alias("n")).where("n > 1")


def missing_properties(quads: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """(s, class, p): instances of rules' (class, p) without the property."""
    r = rules.select(F.col("class").alias("__class"), F.col("p").alias("__p"))
    needed = classes.join(F.broadcast(r), F.col("class") == F.col("__class")).select("s", "class", F.col("__p").alias("p")).distinct()
    return needed.join(quads.select(F.col("s").alias("__s"), F.col("p").alias("__has")).distinct(), (F.col("s") == F.col("__s")) & (F.col("p") == F.col("__has")), "left_anti")


@dataclass(frozen=True)
class Property:
    path: str
    least: int | None = None
    most: int | None = None
    classes: tuple[str, ...] = ()  # one of
    dtype: str | None = None
    kind: str | None = None  # uri or literal


@dataclass(frozen=True)
class Shape:
    name: str
    target: str
    properties: tuple[Property, ...] = field(default_factory=tuple)


def shape_report(quads: DataFrame, classes: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(shape, s, path, rule) of all violations.

    All shapes together: their targets and properties are rows of a small table, each target meets its values once,
    and one group by target and property judges every rule but that of the values' class, which needs a join."""
    spark = quads.sparkSession
    rules = [(x.name, x.target, p.path, p.least, p.most, p.dtype, p.kind, list(p.classes)) for x in shapes for p in x.properties]
    rules = spark.createDataFrame(rules, "shape string, target string, path string, least int, most int, dtype string, kind string, allowed array<string>")
    of = classes.join(F.broadcast(rules), F.col("class") == F.col("target")).drop("class", "target").distinct()
    given = quads.where(F.col("p").isin(sorted({p.path for x in shapes for p in x.properties}))).select(F.col("s").alias("__s"), F.col("p").alias("__p"), "o", "o_kind", "o_dtype")
    values = settled(of.join(given, (F.col("s") == F.col("__s")) & (F.col("path") == F.col("__p")), "left").drop("__s", "__p"), "shape-values")
    # o is null where the property is missing
    there = F.col("o").isNotNull()
    key = ["shape", "s", "path", "least", "most"]
    judged = values.groupBy(*key).agg(
        F.count_distinct("o").alias("n"),
        F.bool_or(there & F.col("kind").isNotNull() & (F.col("o_kind") != F.col("kind"))).alias("nodeKind"),
        F.bool_or(there & F.col("dtype").isNotNull() & ~F.col("o_dtype").eqNullSafe(F.col("dtype"))).alias("datatype"),
    )
    wrong = {"minCount": F.col("n") < F.col("least"), "maxCount": F.col("n") > F.col("most"), "nodeKind": F.col("nodeKind"), "datatype": F.col("datatype")}
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in wrong.items()]), lambda r: r.isNotNull())
    report = judged.select("shape", "s", "path", F.explode(found).alias("rule"))
    typed = values.where(there & (F.size("allowed") > 0)).select("shape", "s", "path", "o", F.explode("allowed").alias("__a"))
    right = classes.select(F.col("s").alias("__o"), F.col("class").alias("__c"))
    met = typed.join(right, (F.col("o") == F.col("__o")) & (F.col("__a") == F.col("__c")), "left")
    outside = met.groupBy("shape", "s", "path", "o").agg(F.count("__c").alias("__n")).where("__n = 0")
    return report.unionByName(outside.select("shape", "s", "path", F.lit("class").alias("rule")).distinct())


def _uri(path: str, *classes: str, least: int | None = None, most: int | None = None) -> Property:
    return Property(path, least, most, classes, kind="uri")


_RELATIONS = ("LandmarkRelation", "AddressSegment", "FinalAddressSegment")
_CHANGES = ("Change", "LandmarkChange", "LandmarkRelationChange", "AttributeChange")
# fixed values: the shapes of the model, a row for each class that a shape targets
SHAPES = [
    Shape("LandmarkShape1", "Landmark", (_uri("isLandmarkType", "LandmarkType", least=1),)),
    Shape("LandmarkShape2", "Landmark", (_uri("hasAttribute", "Attribute"),)),
    Shape("AddressShape1", "Address", (_uri("targets", "Landmark", least=1, most=1),)),
    Shape("AddressShape2", "Address", (_uri("firstStep", "AddressSegment", "FinalAddressSegment", least=1, most=1),)),
    *[Shape("LandmarkRelationShape1", c, (_uri("isLandmarkRelationType", "LandmarkRelationType", least=1, most=1),)) for c in _RELATIONS],
    *[Shape("LandmarkRelationShape2", c, (_uri("locatum", "Landmark", least=1, most=1), _uri("relatum", "Landmark", least=1))) for c in _RELATIONS],
    Shape("AddressSegmentShape1", "AddressSegment", (_uri("nextStep", "AddressSegment", "FinalAddressSegment", least=0, most=1),)),
    Shape("FinalAddressSegmentShape1", "FinalAddressSegment", (_uri("nextStep", most=0),)),
    Shape("AttributeShape1", "Attribute", (_uri("isAttributeType", "AttributeType", least=1, most=1),)),
    Shape("AttributeShape2", "Attribute", (_uri("hasAttributeVersion", "AttributeVersion"),)),
    *[Shape("ChangeShape1", c, (_uri("isChangeType", "ChangeType", least=1, most=1),)) for c in _CHANGES],
    *[Shape("ChangeShape2", c, (_uri("dependsOn", "Event", least=1, most=1),)) for c in _CHANGES],
    Shape("AttributeChangeShape1", "AttributeChange", (_uri("appliedTo", "Attribute", least=1, most=1),)),
    Shape("AttributeChangeShape2", "AttributeChange", (_uri("outdates", "AttributeVersion"), _uri("makesEffective", "AttributeVersion"))),
    Shape("LandmarkChangeShape1", "LandmarkChange", (_uri("appliedTo", "Landmark", least=1, most=1),)),
    Shape("LandmarkRelationChangeShape1", "LandmarkRelationChange", (_uri("appliedTo", "LandmarkRelation", least=1, most=1),)),
    Shape("EventShape1", "Event", (_uri("hasTime", "TimeInstant", "CrispTimeInstant", "FuzzyTimeInstant"),)),
    Shape("CrispTimeInstantShape1", "CrispTimeInstant", (_uri("timePrecision", "TemporalUnit", least=1, most=1), Property("timeStamp", 1, 1, dtype="dateTimeStamp", kind="literal"), _uri("timeCalendar", "TRS", least=1, most=1))),
]


# fixed values: properties that elements of a class must have
MANDATORY = [
    ("Landmark", "isLandmarkType"), ("LandmarkRelation", "isLandmarkRelationType"), ("LandmarkRelation", "locatum"), ("LandmarkRelation", "relatum"), ("Attribute", "isAttributeType"),
    ("Change", "isChangeType"), ("Change", "appliedTo"), ("Change", "dependsOn"), ("Address", "targets"), ("Address", "firstStep"), ("AddressSegment", "nextStep"),
    ("CrispTimeInstant", "timeStamp"), ("CrispTimeInstant", "timePrecision"), ("CrispTimeInstant", "timeCalendar"),
]
# fixed values: domains and ranges of properties; dateTimeStamp is a datatype
DOMAINS = [
    ("isLandmarkType", "Landmark"), ("isLandmarkRelationType", "LandmarkRelation"), ("isAttributeType", "Attribute"), ("isChangeType", "Change"), ("targets", "Address"), ("firstStep", "Address"), ("nextStep", "LandmarkRelation"),
    ("locatum", "LandmarkRelation"), ("relatum", "LandmarkRelation"), ("appliedTo", "Change"), ("dependsOn", "Change"), ("timeStamp", "CrispTimeInstant"), ("timePrecision", "CrispTimeInstant"), ("timeCalendar", "CrispTimeInstant"),
]
RANGES = [
    ("isLandmarkType", "LandmarkType", None), ("isLandmarkRelationType", "LandmarkRelationType", None), ("isAttributeType", "AttributeType", None), ("isChangeType", "ChangeType", None), ("targets", "Landmark", None), ("firstStep", "LandmarkRelation", None),
    ("nextStep", "LandmarkRelation", None), ("locatum", "Landmark", None), ("relatum", "Landmark", None), ("dependsOn", "Event", None), ("timeStamp", None, "dateTimeStamp"), ("timePrecision", "TemporalUnit", None), ("timeCalendar", "TRS", None),
]


def elements_report(quads: DataFrame, classes: DataFrame, rules: list[tuple[str, str]] = MANDATORY) -> DataFrame:
    """(s, class, p, rule) of elements that lack a mandatory property, one pass for all rules."""
    made = quads.sparkSession.createDataFrame(rules, "class string, p string")
    return missing_properties(quads, classes, made).withColumn("rule", F.lit("mandatory"))


def properties_report(quads: DataFrame, classes: DataFrame, domain_rules: list[tuple[str, str]] = DOMAINS, range_rules: list[tuple[str, str | None, str | None]] = RANGES) -> DataFrame:
    """(s, p, o, expected, rule) of statements against domains (p, class) and ranges (p, class, dtype)."""
    domains = quads.sparkSession.createDataFrame(domain_rules, "p string, class string")
    ranges = quads.sparkSession.createDataFrame(range_rules, "p string, class string, dtype string")
    d = domain_violations(quads, classes, domains).select("s", "p", F.lit(None).cast("string").alias("o"), "expected", F.lit("domain").alias("rule"))
    return d.unionByName(range_violations(quads, classes, ranges).withColumn("rule", F.lit("range")))
