"""Filter rules. All look at dimensions and attribute names only, so a rule is asked once per shape of cell and never per row.

A shape is {dimension: attribute names, outermost first}.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from .errors import SpecError

Shape = Mapping[str, tuple[str, ...]]

#: Rule type -> its fields; ``*`` marks a list of names, ``#`` a number, ``&`` a list of rules.
FIELDS = {
    "max_dimensions": ["n#"],
    "min_dimensions": ["n#"],
    "contains_dim": ["dim"],
    "contains_all_dims": ["dims*"],
    "top_level": ["dim"],
    "not_together": ["dims*"],
    "not_with_attribute": ["dim", "other_dim", "attr"],
    "not_alone": ["dim"],
    "only_with": ["dim"],
    "and": ["rules&"],
    "or": ["rules&"],
}

_KEEPS: dict[str, Callable[[dict, Shape], bool]] = {
    "max_dimensions": lambda r, s: len(s) <= r["n"],
    "min_dimensions": lambda r, s: len(s) >= r["n"],
    "contains_dim": lambda r, s: r["dim"] in s,
    "only_with": lambda r, s: r["dim"] in s,
    "contains_all_dims": lambda r, s: set(r["dims"]) <= set(s),
    "top_level": lambda r, s: list(s) == [r["dim"]],
    "not_alone": lambda r, s: list(s) != [r["dim"]],
    "not_together": lambda r, s: not set(r["dims"]) <= set(s),
    "not_with_attribute": lambda r, s: not (r["dim"] in s and r["attr"] in s.get(r["other_dim"], ())),
    "and": lambda r, s: all(keeps(x, s) for x in r["rules"]),
    "or": lambda r, s: any(keeps(x, s) for x in r["rules"]),
}


def keeps(rule: dict, shape: Shape) -> bool:
    return _KEEPS[rule["type"]](rule, shape)


def parse_rule(raw, where: str = "filterRules") -> dict:
    kind = raw.get("type") if isinstance(raw, dict) else None
    if kind not in FIELDS:
        raise SpecError([f"{where}: unknown rule type {kind!r}"])
    names = {f.rstrip("#*&"): f[-1] for f in FIELDS[kind]}
    if set(raw) != {"type", *names}:
        raise SpecError([f"{where}: {kind} takes exactly {', '.join(names)}"])
    out = {"type": kind}
    for name, sort in names.items():
        value = raw[name]
        if sort == "&":
            if not isinstance(value, list):
                raise SpecError([f"{where}: {name} of {kind} is a list of rules"])
            value = [parse_rule(x, where) for x in value]
        elif sort == "*":
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise SpecError([f"{where}: {name} of {kind} is a list of names"])
        elif sort == "#":
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise SpecError([f"{where}: {name} of {kind} is a whole number"])
        elif not isinstance(value, str):
            raise SpecError([f"{where}: {name} of {kind} is a name"])
        out[name] = value
    return out


def dims_of(rule: dict) -> list[str]:
    out = [d for x in rule.get("rules", []) for d in dims_of(x)]
    return [*out, *rule.get("dims", []), *[rule[k] for k in ("dim", "other_dim") if k in rule]]


def most_dimensions(rules: list[dict]) -> int | None:
    """The tightest bound on the number of dimensions that holds for every kept cell; ``or`` gives none."""
    bounds = [r["n"] for r in rules if r["type"] == "max_dimensions"]
    bounds += [b for r in rules if r["type"] == "and" and (b := most_dimensions(r["rules"])) is not None]
    return min(bounds, default=None)
