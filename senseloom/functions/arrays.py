"""SQL of array expressions that stay linear, or nearly so, in the length of an array."""

from __future__ import annotations

#: Values that a running fold copies at a time: the whole takes m * RUN + (m / RUN)^2 steps for m values.
RUN = 256


def let(name: str, value: str, then: str) -> str:
    """An expression over a named value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def running(values: str, zero: str = "0", op: str = "{a} + {x}") -> str:
    """The running folds of an array, each with its own value; op, which must be associative, has a and x."""
    fold = lambda a, x: op.format(a=a, x=x)
    runs = f"transform(sequence(0, cast((size(v) - 1) div {RUN} as int)), k -> slice(v, k * {RUN} + 1, {RUN}))"
    inner = f"transform({runs}, c -> slice(aggregate(c, array({zero}), (a, x) -> concat(a, array({fold('element_at(a, -1)', 'x')}))), 2, {RUN}))"
    before = f"aggregate(q, array({zero}), (a, p) -> concat(a, array({fold('element_at(a, -1)', 'element_at(p, -1)')})))"
    whole = f"flatten(zip_with(q, slice({before}, 1, size(q)), (p, o) -> transform(p, y -> {fold('o', 'y')})))"
    return let("v", values, f"if(size(v) = 0, array(), {let('q', inner, whole)})")
