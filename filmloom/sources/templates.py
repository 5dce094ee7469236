"""Node graphs stored as JSON text: scan and patch, row by row, with input values kept as they are.

Patches take and return the parsed graph. Keep it in a column between patches (:func:`patched`),
so each row is parsed once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPH = "map<string, struct<class_type: string, inputs: map<string, variant>, _meta: variant>>"
# Class names of nodes that load an image, spaces removed.
IMAGE_LOADERS = ["loadimage", "imageloader"]


def _value(value: object) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def nodes_of(body: Column) -> Column:
    return F.from_json(body, GRAPH)


def scan(templates: DataFrame, body: str = "body") -> DataFrame:
    """One row per node input, in node order; values are JSON text."""
    nodes = templates.select("template_id", F.posexplode(nodes_of(F.col(body))).alias("node_pos", "node_id", "node"))
    return nodes.select(
        "template_id", "node_pos", "node_id", F.col("node.class_type").alias("class_type"),
        F.explode("node.inputs").alias("input", "value"),
    ).withColumn("value", F.to_json("value"))


def _with_input(node: Column, name: str, value: Column) -> Column:
    """Set an input of a node, adding it where it is missing."""
    inputs = node["inputs"]
    changed = F.transform_values(inputs, lambda k, v: F.when(k == name, value).otherwise(v))
    added = F.map_concat(inputs, F.create_map(F.lit(name), value))
    return node.withField("inputs", F.when(F.map_contains_key(inputs, name), changed).otherwise(added))


def _patch_first(nodes: Column, hit, patch) -> Column:
    """Patch the first node, in document order, that ``hit`` accepts."""
    entries = F.map_entries(nodes)
    first = F.array_position(F.transform(entries, lambda e: F.coalesce(hit(e["value"]), F.lit(False))), True)

    def step(e: Column, i: Column) -> Column:
        return F.struct(e["key"], F.when(i + 1 == first, patch(e["value"])).otherwise(e["value"]).alias("value"))

    return F.map_from_entries(F.transform(entries, step))


def with_prompt(nodes: Column, text: str) -> Column:
    """New text for the first node that has a ``text`` or ``prompt`` input."""

    def has(node: Column, name: str) -> Column:
        return F.map_contains_key(node["inputs"], name)

    def patch(node: Column) -> Column:
        return F.when(has(node, "text"), _with_input(node, "text", _value(text))).otherwise(
            _with_input(node, "prompt", _value(text))
        )

    return _patch_first(nodes, lambda n: has(n, "text") | has(n, "prompt"), patch)


def _class(node: Column) -> Column:
    return F.replace(F.lower(node["class_type"]), F.lit(" "), F.lit(""))


def with_image(nodes: Column, name: str) -> Column:
    """A new image for the first image-loading node."""
    return _patch_first(nodes, lambda n: _class(n).isin(IMAGE_LOADERS), lambda n: _with_input(n, "image", _value(name)))


def with_knobs(nodes: Column, knobs: Mapping[str, object], by_class: Mapping[str, tuple[str, object]] | None = None) -> Column:
    """Set inputs where a node already has them.

    ``knobs`` maps input names to values for every node; ``by_class`` maps an input name to a
    class name part and the value for nodes of such a class.
    """

    def patched(node: Column) -> Column:
        def value(name: Column, old: Column) -> Column:
            out = old
            for knob, new in knobs.items():
                out = F.when(name == knob, _value(new)).otherwise(out)
            for knob, (part, new) in (by_class or {}).items():
                out = F.when((name == knob) & F.lower(node["class_type"]).contains(part), _value(new)).otherwise(out)
            return out

        return node.withField("inputs", F.transform_values(node["inputs"], value))

    return F.transform_values(nodes, lambda _, node: patched(node))


def with_node_inputs(nodes: Column, by_id: Mapping[str, Mapping[str, object]]) -> Column:
    """Set inputs of the nodes with the given ids, adding inputs that are missing."""

    def patched(node_id: Column, node: Column) -> Column:
        out = node
        for wanted, inputs in by_id.items():
            changed = node
            for name, value in inputs.items():
                changed = _with_input(changed, name, _value(value))
            out = F.when(node_id == wanted, changed).otherwise(out)
        return out

    return F.transform_values(nodes, patched)


def patched(templates: DataFrame, *patches: Callable[[Column], Column], body: str = "body") -> DataFrame:
    """Apply patches one after the other and write the graph back as text."""
    out = templates.withColumn("__nodes", nodes_of(F.col(body)))
    for patch in patches:
        out = out.withColumn("__nodes", patch(F.col("__nodes")))
    return out.withColumn(body, F.to_json("__nodes")).drop("__nodes")
