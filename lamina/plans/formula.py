"""The formula language: ``y ~ x + f:z + I(x**2) + (1 + x | g)``, with ``*``, ``-``, ``||``, ``a/b`` grouping and
``successes / trials`` responses. Parsing and algebra only; no data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

_TOKEN = re.compile(r"\s*(?:(\|\||\*\*|[~+\-*:/|()])|`((?:[^`\\]|\\.)*)`|([A-Za-z_.][\w.]*)|(\d+))")


@dataclass(frozen=True, order=True)
class Factor:
    """A variable, raised to a whole power."""

    name: str
    power: int = 1

    def __str__(self) -> str:
        name = self.name if re.fullmatch(r"[A-Za-z_.][\w.]*", self.name) else f"`{self.name}`"
        return name if self.power == 1 else f"I({name}**{self.power})"


Term = tuple[Factor, ...]  # () is the intercept; several factors are an interaction


@dataclass(frozen=True)
class RandomTerm:
    terms: tuple[Term, ...]
    grouping: tuple[str, ...]
    correlated: bool = True
    cov_type: str = "us"

    @property
    def group(self) -> str:
        return "/".join(self.grouping)

    def __str__(self) -> str:
        inner = " + ".join(["1" if () in self.terms else "0", *[show(t) for t in self.terms if t]])
        return f"({inner} {'|' if self.correlated else '||'} {self.group})"


@dataclass(frozen=True)
class Formula:
    response: str
    fixed: tuple[Term, ...]
    random: tuple[RandomTerm, ...] = ()
    trials: str | None = None

    @property
    def intercept(self) -> bool:
        return () in self.fixed

    @property
    def variables(self) -> list[str]:
        """Every variable once, in order: what the scan has to read."""
        names = [self.response, *([self.trials] if self.trials else []), *[f.name for t in self.fixed for f in t]]
        for r in self.random:
            names += [*[f.name for t in r.terms for f in t], *r.grouping]
        return list(dict.fromkeys(names))

    def fixed_str(self) -> str:
        return " + ".join(["1" if self.intercept else "0", *[show(t) for t in self.fixed if t]])

    def __str__(self) -> str:
        left = self.response + (f" / {self.trials}" if self.trials else "")
        return f"{left} ~ " + " + ".join([self.fixed_str(), *map(str, self.random)])


def show(term: Term) -> str:
    return ":".join(map(str, term)) if term else "1"


def _merge(*lists: list[Term]) -> list[Term]:
    """Terms once each; an interaction is the same whatever the order of its factors."""
    seen: dict[frozenset, Term] = {}
    for term in (t for x in lists for t in x):
        seen.setdefault(frozenset(term), term)
    return list(seen.values())


@dataclass
class _Parser:
    tokens: list[tuple[str, str]]
    at: int = 0
    text: str = field(default="", repr=False)

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want and self.peek() != want):
            raise ValueError(f"expected {want or 'a term'} in formula {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise ValueError(f"expected a name, found {value!r} in {self.text!r}")
        return value

    def formula(self) -> Formula:
        response, trials = self.name(), None
        if self.peek() == "/":
            self.take()
            trials = self.name()
        self.take("~")
        fixed, random = self.sum(bars=True)
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r} in formula {self.text!r}")
        return Formula(response, tuple(fixed), tuple(random), trials)

    def sum(self, bars: bool) -> tuple[list[Term], list[RandomTerm]]:
        terms: list[Term] = [()]
        random: list[RandomTerm] = []
        sign = "+"
        if self.peek() in ("+", "-"):
            sign = self.take()[1]
        while True:
            if bars and self.peek() == "(":
                self.take()
                inner, _ = self.sum(bars=False)
                bar = self.take()[1]
                if bar not in ("|", "||"):
                    raise ValueError(f"expected | in a random term of {self.text!r}")
                groups = [self.name()]
                while self.peek() == "/":
                    self.take()
                    groups.append(self.name())
                self.take(")")
                term = RandomTerm(tuple(inner), tuple(groups), bar == "|")
                random = [r for r in random if r != term] if sign == "-" else [*random, term]
            else:
                found = self.product()
                if found == [None]:  # a literal 0
                    terms = [t for t in terms if t] if sign == "+" else _merge([()], terms)
                elif sign == "-":
                    gone = {frozenset(t) for t in found}
                    terms = [t for t in terms if frozenset(t) not in gone]
                else:
                    terms = _merge(terms, found)
            if self.peek() not in ("+", "-"):
                return sorted(terms, key=bool), random
            sign = self.take()[1]

    def product(self) -> list:
        left = self.colon()
        while self.peek() == "*":
            self.take()
            right = self.colon()
            left = _merge(left, right, [a + b for a in left for b in right])
        return left

    def colon(self) -> list:
        left = self.atom()
        while self.peek() == ":":
            self.take()
            right = self.atom()
            left = [tuple(dict.fromkeys(a + b)) for a in left for b in right]
        return left

    def atom(self) -> list:
        kind, value = self.take()
        if kind == "number" and value in ("0", "1"):
            return [()] if value == "1" else [None]
        if kind != "name":
            raise ValueError(f"unexpected {value!r} in formula {self.text!r}")
        if value == "I" and self.peek() == "(":
            self.take("(")
            name = self.name()
            power = 1
            if self.peek() == "**":
                self.take()
                kind, number = self.take()
                if kind != "number":
                    raise ValueError(f"I(x**k) takes a whole power, in {self.text!r}")
                power = int(number)
            self.take(")")
            return [(Factor(name, power),)]
        return [(Factor(value),)]


def parse(text: str | Formula) -> Formula:
    """A Formula from its text."""
    if isinstance(text, Formula):
        return text
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:].strip()[0]!r} in formula {text!r}")
        op, quoted, name, number = m.groups()
        tokens.append(("op", op) if op else ("name", re.sub(r"\\(.)", r"\1", quoted)) if quoted is not None else ("name", name) if name else ("number", number))
        at = m.end()
    return _Parser(tokens, text=text).formula()


def nobars(formula: str | Formula) -> Formula:
    return replace(parse(formula), random=())


def findbars(formula: str | Formula) -> tuple[RandomTerm, ...]:
    return parse(formula).random


def subbars(formula: str | Formula) -> Formula:
    """Random terms as fixed ones: the grouping factor and its interactions."""
    f = parse(formula)
    extra = [tuple(Factor(g) for g in r.grouping) + t for r in f.random for t in r.terms]
    return replace(f, fixed=tuple(_merge(list(f.fixed), extra)), random=())


def is_mixed(formula: str | Formula) -> bool:
    return bool(parse(formula).random)


def split_double_bars(formula: str | Formula) -> Formula:
    """``(a + b || g)`` as one uncorrelated term for each part."""
    f = parse(formula)
    return replace(f, random=tuple(x for r in f.random for x in ([r] if r.correlated else [replace(r, terms=(t,), correlated=True) for t in r.terms])))


def set_cov_type(formula: str | Formula, kind: str | dict[str, str]) -> Formula:
    """us, cs or ar1 for all random terms, or by (first) grouping factor."""
    f = parse(formula)
    of = (lambda r: kind) if isinstance(kind, str) else (lambda r: kind.get(r.grouping[0], r.cov_type))
    if bad := {of(r) for r in f.random} - {"us", "cs", "ar1"}:
        raise ValueError(f"unknown covariance {bad.pop()!r}")
    return replace(f, random=tuple(replace(r, cov_type=of(r)) for r in f.random))


def update(old: str | Formula, new: str) -> Formula:
    """``. ~ . + x - z``: dots stand for the old sides."""
    f = parse(old)
    left, _, right = new.partition("~")
    right = re.sub(r"(?<![\w.`])\.(?![\w.`])", " + ".join([f.fixed_str(), *map(str, f.random)]), right or left)
    response = (f.response + (f" / {f.trials}" if f.trials else "")) if not _ or left.strip() in ("", ".") else left
    made = parse(f"{response} ~ {right}")
    kinds = {(r.grouping, r.terms): r.cov_type for r in f.random}
    return replace(made, random=tuple(replace(r, cov_type=kinds.get((r.grouping, r.terms), r.cov_type)) for r in made.random))
