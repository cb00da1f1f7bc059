"""Models from files: entities of JSON or YAML documents, and lineage edges of a manifest."""

from __future__ import annotations

import json
from pathlib import Path

from gaugeworks.model import Entity, Filter, Join, Metric, Model, ModelError

_METRIC = {f for f in Metric.__dataclass_fields__} - {"filters", "keys", "must_pin"}
_ENTITY = {"table", "clock", "population", "clock_is_day", "created_once"}


def _known(given: dict, known: set[str], what: str) -> None:
    unknown = sorted(set(given) - known)
    if unknown:
        raise ModelError(f"{what} has unknown keys: {', '.join(unknown)}")


def _metric(name: str, given: dict) -> Metric:
    _known(given, _METRIC | {"filters", "keys", "must_pin"}, f"metric {name}")
    if "agg" not in given:
        raise ModelError(f"metric {name} has no agg")
    filters = tuple(Filter(f["member"], f["op"], f.get("value")) for f in given.get("filters", ()))
    return Metric(
        **{k: v for k, v in given.items() if k in _METRIC}, filters=filters, keys=tuple(given.get("keys", ())), must_pin=tuple(given.get("must_pin", ()))
    )


def entity_of(name: str, given: dict) -> Entity:
    _known(given, _ENTITY | {"members", "metrics", "joins", "definitions", "dates"}, f"entity {name}")
    if "table" not in given or not given.get("members"):
        raise ModelError(f"entity {name} needs a table and members")
    joins = tuple(
        Join(j["to"], tuple(map(tuple, j["on"])), j.get("relationship", ""), j.get("how", "left"), j.get("role", "")) for j in given.get("joins", ())
    )
    return Entity(
        members=dict(given["members"]), metrics={k: _metric(k, m) for k, m in given.get("metrics", {}).items()}, joins=joins,
        definitions=dict(given.get("definitions", {})), dates=tuple(given.get("dates", ())), **{k: v for k, v in given.items() if k in _ENTITY},
    )


def model_of(document: dict) -> Model:
    """The model of {"entities": {name: {table, members, metrics, joins, ...}}}; its names are checked."""
    model = Model({name: entity_of(name, given) for name, given in document.get("entities", {}).items()})
    for name, entity in model.entities.items():
        for join in entity.joins:
            if join.to not in model.entities:
                raise ModelError(f"{name} joins {join.to}, which is no entity")
            for pair in join.on:
                for owner, member in ((name, pair[0]), (join.to, pair[-1])):
                    if member not in model.entities[owner].members:
                        raise ModelError(f"the join of {name} and {join.to} names {owner}.{member}, which is no member")
        for metric in entity.metrics:
            model.operands(f"{name}.{metric}")
    return model


def load_model(path: str) -> Model:
    """A model from one file or from all .json, .yaml and .yml files of a folder; an entity stands in one file."""
    entities: dict = {}
    files = [Path(path)] if Path(path).is_file() else sorted(p for p in Path(path).rglob("*") if p.suffix in (".json", ".yaml", ".yml"))
    for file in files:
        if file.suffix == ".json":
            document = json.loads(file.read_text())
        else:
            try:
                import yaml
            except ImportError as e:
                raise ModelError("YAML models need PyYAML; JSON models need nothing") from e
            document = yaml.safe_load(file.read_text())
        for name, given in (document or {}).get("entities", {}).items():
            if name in entities:
                raise ModelError(f"entity {name} stands in two files")
            entities[name] = given
    return model_of({"entities": entities})


def lineage_edges(manifest: dict) -> list[tuple[str, str]]:
    """(source, target) names of a manifest with nodes that say what they depend on."""
    nodes = {**manifest.get("sources", {}), **manifest.get("nodes", {})}
    name = lambda key: nodes[key].get("relation_name") or nodes[key].get("name") or key
    return sorted({(name(up), name(key)) for key, x in nodes.items() for up in x.get("depends_on", {}).get("nodes", ()) if up in nodes})


def lints(model: Model) -> list[tuple[str, str]]:
    """(what, finding) of a model as it is written: what would mislead a caller, without reading data."""
    found, bodies = [], {}
    for name, entity in model.entities.items():
        if entity.clock and entity.clock not in entity.members:
            found.append((name, f"its clock {entity.clock} is no member"))
        by_expr: dict[str, list[str]] = {}
        for member, expr in entity.members.items():
            by_expr.setdefault(expr.lower(), []).append(member)
        found += [(name, f"members with one expression: {', '.join(x)}") for x in by_expr.values() if len(x) > 1]
        for metric, m in entity.metrics.items():
            try:
                model.operands(f"{name}.{metric}")
            except ModelError as e:
                found.append((f"{name}.{metric}", str(e)))
            if m.level and entity.created_once:
                found.append((f"{name}.{metric}", "a level over rows that are written once"))
            if m.level and not (m.clock or entity.clock):
                found.append((f"{name}.{metric}", "a level without a clock"))
            for f in m.filters:
                try:
                    model.member(f.member, name)
                except ModelError as e:
                    found.append((f"{name}.{metric}", str(e)))
            if m.agg not in ("ratio", "derived"):
                bodies.setdefault((name, m.agg, m.expr.lower()), []).append((metric, m))
    for (name, _, _), twins in bodies.items():
        if len({repr(m.filters) for _, m in twins}) < len(twins):
            found.append((name, f"metrics that compute the same: {', '.join(k for k, _ in twins)}"))
    return sorted(found)
