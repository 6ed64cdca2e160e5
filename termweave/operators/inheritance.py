"""What outline nodes inherit, computed from their parents.

State of a node are its own columns and `parent_id`. Everything it has from above follows from
them, so an edit changes the state only and calls `inherited` for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.closure import MAX_ROUNDS
from termweave.plans.cut import cut
from termweave.sources.outline import section_type

_NEAREST = ["_section", "_name", "_above_id", "_relation", "_parent_uri"]
_ANY = ["_in", "_under"]


def _passed_on() -> list[Column]:
    """What a node gives to those below it."""
    return [F.when(F.col("resourcedefs"), F.struct("own_id")).alias("_section"), F.col("own_localname").alias("_name"),
            F.col("own_id").alias("_above_id"), F.col("own_relation").alias("_relation"), F.col("uri").alias("_parent_uri"),
            F.coalesce(F.col("context_type") == "ontology", F.lit(False)).alias("_in"),
            F.coalesce("tagged_nodeclare", F.lit(False)).alias("_under")]


def _steps(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """(doc, node_id, _up, _depth): the parent, and by how much the node lies deeper than it.

    A node that keeps its parent keeps the difference, any other lies one below its parent.
    """
    old = before.select("doc", "node_id", F.col("parent_id").alias("_old"), F.col("level").alias("_level"))
    above = before.select("doc", F.col("node_id").alias("_old"), F.col("level").alias("_above"))
    was = old.join(above, ["doc", "_old"], "left")
    stayed = F.col("_level").isNotNull() & F.col("parent_id").eqNullSafe(F.col("_old"))
    depth = F.when(stayed, F.col("_level") - F.coalesce("_above", F.lit(0))).otherwise(1)
    return nodes.select("doc", "node_id", "parent_id").join(was, ["doc", "node_id"], "left").select(
        "doc", "node_id", F.col("parent_id").alias("_up"), depth.cast("long").alias("_depth"))


def inherited(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """The nodes with level, parent_uri, relation, rdf_type, section_id, in_section, nodeclare,
    in_ontology, localname and inherited_id computed anew; `before` has the levels so far.

    A node knows the topmost ancestor it has heard of and what all up to it pass on, the
    nearest first. Every round appends what that ancestor knows, so the rounds are the
    logarithm of the depth and a row never holds a path. Parents must not form a cycle.
    """
    gives = nodes.select("doc", F.col("node_id").alias("_up"), *_passed_on())
    state = cut(_steps(nodes, before).join(gives, ["doc", "_up"], "left"))
    for _ in range(MAX_ROUNDS):
        far = state.select("doc", F.col("node_id").alias("_up"), F.col("_up").alias("_next"), F.col("_depth").alias("_more"),
                           *[F.col(c).alias("_far" + c) for c in _NEAREST + _ANY])
        state = cut(state.join(far, ["doc", "_up"], "left").select(
            "doc", "node_id", F.col("_next").alias("_up"), (F.col("_depth") + F.coalesce("_more", F.lit(0))).alias("_depth"),
            *[F.coalesce(c, "_far" + c).alias(c) for c in _NEAREST],
            *[(F.coalesce(c, F.lit(False)) | F.coalesce("_far" + c, F.lit(False))).alias(c) for c in _ANY]))
        if state.where("_up IS NOT NULL").isEmpty():
            break
    else:
        raise ValueError("parents form a cycle")
    section = F.col("_section.own_id")
    new = {
        "level": F.col("_depth").cast("int"), "parent_uri": F.col("_parent_uri"), "relation": F.col("_relation"),
        "rdf_type": F.when(section.isNotNull(), section_type(section)).when(
            F.endswith("own_id", F.lit("-ontology-declaration")), "owl:Ontology"),
        "section_id": section, "in_section": F.col("_section").isNotNull(),
        "nodeclare": F.coalesce("tagged_nodeclare", F.lit(False)) | F.coalesce("_under", F.lit(False)),
        "in_ontology": F.coalesce("_in", F.lit(False)) | F.coalesce(F.col("context_type") == "ontology", F.lit(False)),
        "localname": F.coalesce("own_localname", "_name"), "inherited_id": F.coalesce("own_id", "_above_id"),
    }
    joined = nodes.join(state.drop("_up"), ["doc", "node_id"])
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in nodes.columns])
