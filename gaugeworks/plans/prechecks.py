"""Checks of a request before it is planned, in a fixed order: names, definitions, one base, join paths, windows, the plan's own rules."""

from __future__ import annotations

from datetime import date

from gaugeworks.model import Model, ModelError, Request
from gaugeworks.plans.compiler import Plan


def _refusal(of) -> str:
    try:
        of()
    except ModelError as e:
        return str(e)
    return ""


def _window(request: Request) -> None:
    if request.window:
        try:
            start, end = (date.fromisoformat(x[:10]) for x in request.window)
        except ValueError as e:
            raise ModelError(f"a window has two days: {request.window}") from e
        if start >= end:
            raise ModelError(f"the window {request.window[0]} to {request.window[1]} holds no day")


def pre_checks(model: Model, request: Request) -> list[tuple[str, str]]:
    """(check, reason) of everything that refuses a request, in order; without any, it can be planned.

    declared: metrics and members that the model does not have, or has more than once. definitions: named
    conditions likewise. one_base: metrics of several entities. paths: members that no safe path of joins reaches.
    window: a window that holds no day. plan: what the compiler refuses besides (clocks, levels beside flows,
    unpinned dimensions, columns of one name), once the others pass. Nothing is read.
    """
    found = []
    metrics = {m: _refusal(lambda: model.operands(m)) for m in request.metrics}
    owners = {model.metric(o)[0] for m, no in metrics.items() if not no for o in model.operands(m)}
    base = owners.pop() if len(owners) == 1 else ""
    members = [*request.dimensions, *request.fields, *(f.member for f in request.filters)]
    names = {n: _refusal(lambda: model.member(n, base)) for n in dict.fromkeys(members)}
    found += [("declared", no) for no in [*metrics.values(), *names.values()] if no]
    if not base and not request.metrics:
        first = [n for n in (*request.fields, *request.dimensions) if not names[n]]
        base = model.member(first[0])[0] if first else ""
    found += [("definitions", no) for d in request.definitions if (no := _refusal(lambda: model.definition(d, base)))]
    if owners:
        found.append(("one_base", f"metrics of several entities: {', '.join(sorted(owners))}"))
    if base:
        reached = dict.fromkeys(model.member(n, base)[0] for n, no in names.items() if not no)
        found += [("paths", no) for e in reached if (no := _refusal(lambda: model.path(base, e)))]
    if no := _refusal(lambda: _window(request)):
        found.append(("window", no))
    if not found and (no := _refusal(lambda: Plan(model, lambda name: None, request))):
        found.append(("plan", no))
    return found
