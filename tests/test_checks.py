"""All row checks in one scan give what the single checks give."""

import random

from termweave.operators import checks as C

KINDS = ["owl:Class", "owl:NamedIndividual", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "rdfs:Datatype", None]
SECTIONS = ["-class-hierarchy", "-individuals", "-object-property-hierarchy", "-data-property-hierarchy", "-annotation-property-hierarchy",
            "-ontology", "-datatypes", None]
TAGS = ["SubClassOf", "EquivalentTo", "Types", "Facts", "SameAs", "Domain", "Range", "SubPropertyChain", "Import", "Rule", "rdfs:comment", "ex:note",
        "ex:p1", "note"]
WORDS = ["x:1", "x:2", "x:3", "x:4", "x:5", "ex:p1", "ex:note", "y:none", "owl:Thing", "xsd:string", "some", "and", "(x:1", "x:2)", ",", "o", '"text"']


def test_one_scan_equals_single_checks(spark):
    dice = random.Random(7)
    rows = [(dice.choice("ab"), dice.choice(["x:1", "x:2", "x:3", "heading", None]), dice.choice(SECTIONS), dice.choice(TAGS),
             dice.choice([None, "", " ", *[" ".join(dice.choice(WORDS) for _ in range(dice.randint(1, 5))) for _ in range(9)]]), n) for n in range(600)]
    frame = spark.createDataFrame(rows, "source string, subject string, section string, tag string, value string, row_ord long").repartition(3)
    types = spark.createDataFrame([(s, "x:1", "owl:Class") for s in "ab"] + [(s, i, dice.choice(KINDS)) for s in "ab" for i in ("x:2", "x:3", "x:4", "ex:p1", "ex:note", "xsd:string") for _ in range(2)],
                                  "source string, id string, rdf_type string")
    for scope in ([], ["source"]):
        declared = C.declared_terms(types, scope)
        tags = frame.where(~frame.tag.isin(C.K.ALL_KEYWORDS))
        single = [C.check_annotation_props(tags, declared, scope), C.check_axiom_ids(frame, declared, scope), C.check_keyword_section(frame),
                  C.check_keyword_range(frame, declared, scope), C.check_facts_punning(frame, declared, scope), C.check_blank_axiom(frame),
                  C.check_recursive(frame)]
        want = sorted((tuple(r) for s in single for r in s.collect()), key=repr)
        assert len({w[0] for w in want}) == 7
        got = sorted((tuple(r) for r in C.row_issues(frame, declared, scope).collect()), key=repr)
        assert [g for g in got if g not in want] == [] and [w for w in want if w not in got] == [] and len(got) == len(want)
