"""The semantic model: entities with members, metrics and declared joins, told apart by name."""

from __future__ import annotations

from dataclasses import dataclass, field


class ModelError(ValueError):
    """A request or model that has no safe answer."""


@dataclass(frozen=True)
class Filter:
    """A condition on a member: = != > >= < <= in like contains set notSet inDateRange."""

    member: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Metric:
    """A named number.

    agg is sum, count, avg, min, max, count_distinct or sum_distinct_on (one value for each of `keys`)
    over `expr`, or ratio (of two metrics), or derived (a formula with {names} of metrics). A level
    metric is read at one snapshot of its clock, the last or the first.
    """

    agg: str
    expr: str = "1"
    filters: tuple[Filter, ...] = ()
    keys: tuple[str, ...] = ()
    num: str = ""
    den: str = ""
    formula: str = ""
    level: bool = False
    snapshot: str = "last"
    clock: str = ""
    must_pin: tuple[str, ...] = ()
    any_in_window: bool = False
    weight: str = ""


@dataclass(frozen=True)
class Join:
    """A declared join to another entity on pairs of members (own, other), or triples with an operator between.

    With a role the other entity is joined once more under that name, and its members are `role.member`.
    """

    to: str
    on: tuple[tuple[str, ...], ...]
    relationship: str = ""
    how: str = "left"
    role: str = ""


@dataclass(frozen=True)
class Entity:
    """A table: members by name as SQL expressions over its columns, and what is declared about it.

    clock_is_day: the clock means days, though moments may be stored. created_once: a row is written once, at
    its clock, so without a window a level is read over the whole table. dates: members that are days; a level
    grouped by one has a snapshot for each. definitions: named conditions. labels: members that only name another
    one; who groups by a label groups by its key too.
    """

    table: str
    members: dict[str, str]
    metrics: dict[str, Metric] = field(default_factory=dict)
    joins: tuple[Join, ...] = ()
    clock: str = ""
    population: str = ""
    clock_is_day: bool = False
    created_once: bool = False
    dates: tuple[str, ...] = ()
    definitions: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Request:
    """What a caller asks for; window is half-open [start, end) on the metrics' clock."""

    metrics: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    definitions: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    grain: str = ""
    window: tuple[str, str] | None = None
    order: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int = 0


SAFE = {"many_to_one", "one_to_one"}
_BACK = {"many_to_one": "one_to_many", "one_to_many": "many_to_one"}


@dataclass(frozen=True)
class Model:
    """Entities by name; timezone: that of days and wall clocks in requests, beside moments stored with a zone."""

    entities: dict[str, Entity]
    timezone: str = ""

    def __post_init__(self):
        """Entities that are joined under a role stand in the model under the role's name too."""
        for entity in list(self.entities.values()):
            for join in entity.joins:
                if join.role:
                    if join.role in self.entities and self.entities[join.role].table != self.entities[join.to].table:
                        raise ModelError(f"the role {join.role} has the name of another entity")
                    other = self.entities[join.to]
                    self.entities[join.role] = Entity(other.table, other.members, joins=other.joins, population=other.population, labels=other.labels)

    def definition(self, name: str, base: str) -> tuple[str, str]:
        """(entity, condition) of a named definition, the base's before others'."""
        entity, _, bare = name.rpartition(".")
        owners = [e for e, x in self.entities.items() if bare in x.definitions and entity in ("", e)]
        if base in owners:
            return base, self.entities[base].definitions[bare]
        if len(owners) != 1:
            raise ModelError(f"definition {name} is {'ambiguous' if owners else 'unknown'}")
        return owners[0], self.entities[owners[0]].definitions[bare]

    def member(self, name: str, base: str = "") -> tuple[str, str]:
        """(entity, member) of a qualified or bare name; a bare one is the base's, or must be one entity's only."""
        if "." in name:
            entity, member = name.split(".", 1)
            if entity not in self.entities or member not in self.entities[entity].members:
                raise ModelError(f"no member {name}")
            return entity, member
        if base and name in self.entities[base].members:
            return base, name
        roles = {j.role for x in self.entities.values() for j in x.joins} - {""}
        owners = [e for e, x in self.entities.items() if name in x.members and e not in roles]
        if len(owners) != 1:
            raise ModelError(f"{name} is {'ambiguous: ' + ', '.join(owners) if owners else 'unknown'}")
        return owners[0], name

    def metric(self, name: str) -> tuple[str, Metric]:
        entity, _, bare = name.rpartition(".")
        owners = [e for e, x in self.entities.items() if bare in x.metrics and entity in ("", e)]
        if len(owners) != 1:
            raise ModelError(f"metric {name} is {'ambiguous' if owners else 'unknown'}")
        return owners[0], self.entities[owners[0]].metrics[bare]

    def operands(self, name: str, within: tuple[str, ...] = ()) -> list[str]:
        """The simple metrics that a metric rests on, itself if it is simple."""
        if name in within:
            raise ModelError(f"metric {name} rests on itself")
        entity, m = self.metric(name)
        parts = [m.num, m.den] if m.agg == "ratio" else placeholders(m.formula) if m.agg == "derived" else []
        if not parts:
            return [f"{entity}.{name.rpartition('.')[2]}"]
        return list(dict.fromkeys(x for p in parts for x in self.operands(p, (*within, name))))

    def path(self, base: str, target: str) -> list[tuple[str, Join, bool]]:
        """Hops (from, join, forwards) of the shortest declared path; refused if one may multiply base rows."""
        seen: dict[str, list] = {base: []}
        queue = [base]
        while queue and target not in seen:
            here = queue.pop(0)
            for name, entity in self.entities.items():
                for join in entity.joins:
                    to = join.role or join.to
                    for a, b, forwards in ((name, to, True), (to, name, False)):
                        if a == here and b not in seen:
                            seen[b] = [*seen[a], (name, join, forwards)]
                            queue.append(b)
        if target not in seen:
            raise ModelError(f"no declared path from {base} to {target}")
        for name, join, forwards in seen[target]:
            kind = join.relationship if forwards else _BACK.get(join.relationship, join.relationship)
            if kind not in SAFE:
                raise ModelError(f"joining {name} and {join.to} may multiply rows of {base} ({kind or 'undeclared'})")
        return seen[target]


def placeholders(formula: str) -> list[str]:
    return [x.split("}")[0] for x in formula.split("{")[1:]]
