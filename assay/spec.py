"""What a user declares: suites of checks, checks of clauses, and their rules.

Plain frozen records; every constructor refuses what could not be measured, so
an operator never meets a malformed suite.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

# The comparison operators, duration units in seconds, baselines.
OPERATORS = ("=", "!=", "<", "<=", ">", ">=")
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
BASELINES = ("previous run", "same weekday", "last runs")
FEWEST_RUNS, MOST_RUNS = 2, 100


def collapse(text: str | None) -> str:
    """Whitespace runs as one space, trimmed: the form ids are made from."""
    return " ".join((text or "").split())


def short_hash(*parts: str) -> str:
    """16 hex digits of the sha1 of NUL-joined parts."""
    joined = "\0".join(parts)
    return hashlib.sha1(joined.encode(), usedforsecurity=False).hexdigest()[:16]


def magnitude(value: float | str) -> float:
    """`5`, `"5%"` or `"2h"` as the number a measured value is compared with."""
    if not isinstance(value, str):
        return float(value)
    text = value.strip()
    if text.endswith("%"):
        return float(text[:-1])
    if text[-1:] in SECONDS:
        return float(text[:-1]) * SECONDS[text[-1]]
    return float(text)


@dataclass(frozen=True)
class Rule:
    """`Rule("<", "5%")`, `Rule("between", 1, 9)`, `Rule("not between", 1, 9)`."""

    op: str
    low: float | str
    high: float | str | None = None

    def __post_init__(self) -> None:
        if self.op in ("between", "not between"):
            if self.high is None:
                raise ValueError(f"{self.op} needs two bounds")
        elif self.op not in OPERATORS or self.high is not None:
            raise ValueError(f"not a rule: {self}")
        magnitude(self.low)

    @property
    def relative(self) -> bool:
        """Whether a bound is written in percent."""
        return any(isinstance(v, str) and "%" in v for v in (self.low, self.high))

    def as_row(self) -> tuple[str, float, float | None, str]:
        """op, low, high and the rule as text."""
        high = None if self.high is None else magnitude(self.high)
        return self.op, magnitude(self.low), high, str(self)

    def __str__(self) -> str:
        bounds = f"{self.low}" if self.high is None else f"{self.low} and {self.high}"
        return f"{self.op} {bounds}"


@dataclass(frozen=True)
class Change:
    """What a clause's value is compared with, instead of being judged itself."""

    baseline: str = "previous run"
    runs: int = 1

    def __post_init__(self) -> None:
        if self.baseline not in BASELINES:
            raise ValueError(f"baseline must be one of {', '.join(BASELINES)}")
        if self.baseline == "last runs" and not FEWEST_RUNS <= self.runs <= MOST_RUNS:
            raise ValueError(f"last runs takes {FEWEST_RUNS} to {MOST_RUNS} runs")

    def __str__(self) -> str:
        return f"last {self.runs} runs" if self.baseline == "last runs" else self.baseline


@dataclass(frozen=True)
class Clause:
    """One metric call and the rule its value must satisfy."""

    metric: str
    args: tuple[str, ...] = ()
    expect: Rule | None = None
    warn: Rule | None = None
    fail: Rule | None = None
    where: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    name: str | None = None
    change: Change | None = None

    def __post_init__(self) -> None:
        from assay.operators.metrics import metric_named

        metric = metric_named(self.metric)
        object.__setattr__(self, "args", tuple(self.args))
        problems = metric.problems(self)
        if self.expect is None and not (self.warn or self.fail):
            if metric.default_rule is None:
                problems.append(f"{self.metric} needs an expectation or triggers")
            object.__setattr__(self, "expect", metric.default_rule)
        elif self.expect is not None and (self.warn or self.fail):
            problems.append("an expectation and triggers exclude each other")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def call(self) -> str:
        """`missing_count(email)`, or `change(row_count, last 7 runs)`."""
        call = f"{self.metric}({', '.join(self.args)})" if self.args else self.metric
        if self.change is None:
            return call
        if self.change.baseline == "previous run":
            return f"change({call})"
        return f"change({call}, {self.change})"

    @property
    def key(self) -> str:
        return self.name or self.call

    @property
    def relative_change(self) -> bool:
        rules = (self.expect, self.warn, self.fail)
        return self.change is not None and any(r.relative for r in rules if r)

    @property
    def expression(self) -> str:
        """The clause as normalised text."""
        parts = [f"{self.call} {self.expect}" if self.expect else self.call]
        parts += [f"warn when {self.warn}"] if self.warn else []
        parts += [f"fail when {self.fail}"] if self.fail else []
        return " | ".join(parts)

    def id_on(self, check_id: str) -> str:
        """The clause's identity: what it measures on its check, never its rule."""
        from assay.operators.metrics import metric_named

        sql = [
            f"{name}={collapse(self.options[name])}"
            for name in metric_named(self.metric).identity_options
            if name in self.options
        ]
        return short_hash("clause", check_id, self.key, collapse(self.where), *sql)


@dataclass(frozen=True)
class Check:
    """A named set of clauses that must all hold."""

    name: str
    clauses: tuple[Clause, ...]
    enabled: bool = True
    notify: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "clauses", tuple(self.clauses))
        keys = [c.key for c in self.clauses]
        if not keys or len(set(keys)) < len(keys):
            raise ValueError(f"check {self.name!r} needs clauses with distinct names")

    @property
    def expression(self) -> str:
        return "; ".join(clause.expression for clause in self.clauses)


@dataclass(frozen=True)
class Suite:
    """The checks on one dataset, and what scopes and describes them all."""

    dataset: str
    checks: tuple[Check, ...]
    datasource: str = "spark"
    filter: str | None = None
    owner: str | None = None
    tags: tuple[str, ...] = ()
    path: str = ""
    zone: str = "UTC"

    def __post_init__(self) -> None:
        object.__setattr__(self, "checks", tuple(self.checks))
        names = [check.name for check in self.checks]
        if len(set(names)) < len(names):
            raise ValueError(f"two checks on {self.dataset!r} share a name")

    def check_id(self, check: Check) -> str:
        """A check's identity: its name on its dataset on its datasource."""
        return short_hash("check", self.datasource, self.dataset, check.name)

    def clause_ids(self) -> list[tuple[str, Check, Clause]]:
        """Every clause of every enabled check with its id, in written order."""
        return [
            (clause.id_on(self.check_id(check)), check, clause)
            for check in self.checks
            if check.enabled
            for clause in check.clauses
        ]
