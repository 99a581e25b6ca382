"""Operator graphs in JSON files: one effect a file, with its name, parameters, nodes and output.

``{"name": ..., "params": {name: {"default", "min", "max"}}, "nodes": {id: {"kind": ..., field or input: ...}}, "out": id}``. A
field or input is a number, a text, ``"$name"`` for a parameter or ``"#id"`` for a node (``"#id.tap"`` for a delay's tap). Nodes are visited in the order of the file, so a delay whose tap closes a loop stands first.
"""

from __future__ import annotations

import json
from pathlib import Path

from tonaris.plans.graph import KINDS, Graph, GraphError, operator
from tonaris.plans.params import Operator, Param, Registry


def _params(declared: dict) -> tuple[Param, ...]:
    """Parameters in order of their names."""
    return tuple(Param(name, "float", d.get("default", 0.0), d.get("min", float("-inf")), d.get("max", float("inf"))) for name, d in sorted(declared.items()))


def _build(document: dict):
    def build(g: Graph) -> None:
        nodes, made = document["nodes"], {}
        for name, body in nodes.items():
            if body.get("kind") not in KINDS or body["kind"] in ("const", "param"):
                raise GraphError(f"node {name!r}: unknown kind {body.get('kind')!r}")
            made[name] = g._node(body["kind"])

        def value(x):
            if isinstance(x, str) and x.startswith("$"):
                return g.param(x[1:])
            if isinstance(x, str) and x.startswith("#"):
                name, _, port = x[1:].partition(".")
                if name not in made or port not in ("", "out", "tap"):
                    raise GraphError(f"no node or output {x!r}")
                return made[name].tap if port == "tap" else made[name]
            return x

        for name, body in nodes.items():
            ports, fields = KINDS[body["kind"]]
            for key, x in body.items():
                if key == "kind":
                    continue
                x = value(x)
                if key in ports:
                    made[name].connect(x, key)
                elif key not in fields:
                    raise GraphError(f"{body['kind']} has no field {key!r}")
                else:
                    made[name].node.fields[key] = x.node if hasattr(x, "node") else x if isinstance(x, str) else float(x)
        g.out(value(document["out"]))

    return build


def load(path: str, rate: float) -> Operator:
    """The operator that a file describes; kind ``script``, its name as implementation. Whatever is wrong with it is a GraphError that names the file."""
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
        if not str(document.get("name", "")).strip():
            raise GraphError("the effect has no name")
        return operator("script", document["name"], _params(document.get("params", {})), _build(document), rate)
    except (OSError, KeyError, TypeError, AttributeError, ValueError) as e:
        raise GraphError(f"{path}: {type(e).__name__}: {e}") from e


def load_folder(folder: str, rate: float) -> list[Operator]:
    """Operators of all ``.json`` files of a folder in order of their names; one bad file, or two effects of one name, fail the whole."""
    out: dict[str, tuple[str, Operator]] = {}
    for path in sorted(map(str, Path(folder).glob("*.json"))):
        op = load(path, rate)
        if op.impl in out:
            raise GraphError(f"{out[op.impl][0]} and {path} both declare {op.impl!r}")
        out[op.impl] = (path, op)
    return [op for _, op in out.values()]


def register(registry: Registry, op: Operator) -> None:
    """Add a graph to a registry; a name that is taken is refused instead of hidden."""
    if any((o.kind, o.impl) == (op.kind, op.impl) for o in registry.rows):
        raise GraphError(f"{op.kind}/{op.impl} is registered already")
    registry.register(op)
