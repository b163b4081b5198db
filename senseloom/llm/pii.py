"""Personal data by weak supervision, in DataFrame functions alone.

Spans that four regular expressions and their checks find are the base and
always stay. Further candidates (numbers in national form, card numbers with a
wrong digit, spelled-out addresses, IPv6) come from wider expressions. On all
candidates four labelers vote yes, no or nothing: the strict form, a gazetteer
(top-level domains, issuers, reserved networks, calling codes), the words
in front, and the edges of the span. Expectation-maximisation over the counts of vote
patterns estimates how far each labeler can be relied on; its posteriors
train a logistic classifier, which decides on the further candidates.
Patterns are few, whatever the corpus (KINDS x 3^4 x 2): they are all that reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables

KINDS = ("email", "ip", "card", "phone")
_L = "[A-Za-z0-9._%+-]"
#: Each begins only where the plain expression's leftmost match can begin, and gives nothing back, so that it runs in linear time.
STRICT = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": STRICT["card"],
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: A cheap test that holds wherever the expression can match.
HINT = {"email": "@", "ip": None, "card": None, "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|kontakt|contacto|adresse|correo",
    "ip": r"\bip\b|server|host|address|adresse|login|servidor",
    "card": "card|visa|credit|carte|karte|tarjeta|payment",
    "phone": r"phone|\btel|call|fax|mobile|anruf|appel|llam",
}
AGAINST = r"order|invoice|version|\bv\b|isbn|\bid\b|serial|ref|nr"
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|co|us|ch|at|it|nl"
VOTES = ("form", "gazetteer", "context", "edges")


def _let(name: str, value: str, then: str) -> str:
    """SQL for an expression over a named value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {then})[0]"


#: Values that a running sum copies at a time: the whole takes m * RUN + (m / RUN)^2 steps for m values.
RUN = 256


def _running(values: str, zero: str, op: str) -> str:
    """SQL for the running folds of an array, each with its own value; op has a and x."""
    fold = lambda a, x: op.format(a=a, x=x)
    runs = f"transform(sequence(0, cast((size(v) - 1) div {RUN} as int)), k -> slice(v, k * {RUN} + 1, {RUN}))"
    inner = f"transform({runs}, c -> slice(aggregate(c, array({zero}), (a, x) -> concat(a, array({fold('element_at(a, -1)', 'x')}))), 2, {RUN}))"
    before = f"aggregate(q, array({zero}), (a, p) -> concat(a, array({fold('element_at(a, -1)', 'element_at(p, -1)')})))"
    whole = f"flatten(zip_with(q, slice({before}, 1, size(q)), (p, o) -> transform(p, y -> {fold('o', 'y')})))"
    return _let("v", values, f"if(size(v) = 0, array(), {_let('q', inner, whole)})")


def _matches(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, m, b, f, t>>: each match in code points, with up to 24 characters of the gap in front of it, and the characters next to it.

    Every search goes on where the last one ended (\\G), so the gaps add up to places, and no place is looked up in the text, whatever its length.
    """
    p = ("\\G([\\s\\S]*?)(" + pattern + ")").replace("\\", "\\\\").replace("'", "\\'")
    both, own = f"regexp_extract_all({text}, '{p}', 0)", f"regexp_extract_all({text}, '{p}', 2)"
    gap = "left(x, length(x) - length(z.o[i]))"
    after = f"if(i + 1 < size(w), left(get(w, i + 1), 1), substr({text}, z.e[i] + 1, 1))"
    front = "if(i > 0 and length(x) = length(z.o[i]), 'x', right(g, 1))"  # where two matches touch, the first one's end is a letter or a digit
    each = "struct(z.e[i] - length(z.o[i]) as s, z.e[i] as e, z.o[i] as m, right(g, 24) as b, " + front + f" as f, {after} as t)"
    rows = f"transform(w, (x, i) -> {_let('g', gap, each)})"
    return _let("w", both, _let("z", f"struct({own} as o, {_running('transform(w, x -> length(x))', '0', '{a} + {x}')} as e)", rows))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    at = f"cast(substr(reverse({_digits(m)}), i, 1) as int)"
    return f"aggregate(transform(sequence(1, length({_digits(m)})), i -> if(i % 2 = 1, {at}, if({at} > 4, 2 * {at} - 9, 2 * {at}))), 0, (a, x) -> a + x) % 10 = 0"


def _octets(m: str) -> str:
    return f"{m} rlike '^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}}|(?<=0))(?:\\\\.|$)){{4}}$'"


CHECK = {"email": "true", "ip": _octets("x.m"), "card": _luhn("x.m"), "phone": f"length({_digits('x.m')}) between 9 and 15"}

GAZETTEER = {
    "email": f"if(lower(x.m) rlike '(?:\\\\.|dot[\\\\])] ?)(?:{TLDS})$', 1, -1)",
    "ip": "if(x.m rlike '^(?:0|127|255)\\\\.', -1, 1)",
    "card": f"if({_digits('x.m')} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)', 1, -1)",
    "phone": f"if(x.m like '+%' or {_digits('x.m')} rlike '^[2-9][0-9]{{2}}[2-9]', 1, -1)",
}


def _candidates(kind: str) -> str:
    """SQL for the candidates of a kind, each with its votes; base tells those that always stay."""
    strict = f"filter({_matches('text', STRICT[kind])}, x -> {CHECK[kind]})"
    hint = f"contains(text, '{HINT[kind]}') and " if HINT[kind] else ""
    when = STRICT[kind].replace("\\", "\\\\").replace("|\\\\G", "")
    base = f"if({hint}text rlike '{when}', {strict}, array())"
    if kind == "card":
        other = f"filter({_matches('text', WIDE[kind])}, x -> not ({CHECK[kind]}))"
    else:
        other = _matches("text", WIDE[kind])
    p = WIDE[kind].replace("\\", "\\\\")
    wide = f"if(text rlike '{p}', {other}, array())"
    before = "lower(x.b)"
    about, against = (c.replace("\\", "\\\\") for c in (CONTEXT[kind], AGAINST))
    context = f"if({before} rlike '{about}', 1, if({before} rlike '{against}', -1, 0))"
    edges = "if(x.f rlike '[A-Za-z0-9]' or x.t rlike '[A-Za-z0-9]', -1, 1)"
    k = KINDS.index(kind)

    def voted(found: str, is_base: bool) -> str:
        form = "1" if is_base else "-1" if kind == "card" else "0"
        return f"transform({found}, x -> struct({k} as kind, x.s as s, x.e as e, {str(is_base).lower()} as base, {form} as form, {GAZETTEER[kind]} as gazetteer, {context} as context, {edges} as edges))"

    return f"concat({voted(base, True)}, {voted(wide, False)})"


def _free() -> str:
    """SQL for cands without the further ones that overlap a base span, by the furthest end of those that start before and the first start after."""
    last = _running("transform(c, x -> if(x.x.base, x.e, 0))", "0", "greatest({a}, {x})")
    first = f"reverse({_running('reverse(transform(c, x -> if(x.x.base, x.s, 2147483647)))', '2147483647', 'least({a}, {x})')})"
    keep = "array_sort(filter(transform(c, (x, i) -> if(x.x.base or not (z.l[i] > x.s or z.n[i] < x.e), x.x, null)), x -> x is not null))"
    return f"if(exists(cands, x -> not x.base), {_let('c', 'array_sort(transform(cands, x -> struct(x.s as s, x.e as e, x as x)))', _let('z', f'struct({last} as l, {first} as n)', keep))}, cands)"


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and cands: all candidates in order of kind and place; further ones that overlap a base span are left out."""
    t = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = t.select(*keep, F.expr(f"array_sort(concat({', '.join(map(_candidates, KINDS))}))").alias("cands"))
    return found.withColumn("cands", F.expr(_free()))


@dataclass(frozen=True)
class Model:
    """reliability: by labeler, the chance of its votes (-1, 0, 1) if personal data and if not; weights: of the classifier."""

    reliability: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]
    weights: dict[str, float]

    def keep(self, x: str) -> str:
        """SQL that holds for candidates to keep."""
        w = self.weights
        parts = [f"case {x}.kind {' '.join(f'when {k} then {w[name]!r}D' for k, name in enumerate(KINDS))} else 0D end", f"if({x}.base, {w['base']!r}D, 0D)"]
        parts += [f"{x}.{v} * {w[v]!r}D" for v in VOTES]
        return f"({x}.base or {' + '.join(parts)} >= 0)"


def fit(cands: DataFrame, rounds: int = 30, steps: int = 400) -> Model:
    """Estimate the labelers' reliability and train the classifier on the counts of all vote patterns."""
    grouped = cands.select(F.explode("cands").alias("x")).groupBy("x.kind", "x.base", *(f"x.{v}" for v in VOTES)).agg(F.count("*").alias("n"))
    rows = sorted((tuple(r) for r in grouped.collect()), key=str)
    prior = 0.7
    rely = {v: [[0.1, 0.3, 0.6], [0.5, 0.3, 0.2]] for v in VOTES}
    post = [prior] * len(rows)
    for _ in range(rounds if rows else 0):
        for i, r in enumerate(rows):
            yes, no = math.log(prior), math.log(1 - prior)
            for v, vote in zip(VOTES, r[2:6]):
                yes += math.log(rely[v][0][vote + 1])
                no += math.log(rely[v][1][vote + 1])
            post[i] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
        n_yes, n_all = sum(p * r[6] for p, r in zip(post, rows)), sum(r[6] for r in rows)
        prior = min(0.99, max(0.01, (n_yes + 1) / (n_all + 2)))
        for j, v in enumerate(VOTES):
            for side in (0, 1):
                got = [2.0 * x for x in ((0.1, 0.3, 0.6), (0.5, 0.3, 0.2))[side]]  # a prior of two votes that keeps yes and no apart
                for p, r in zip(post, rows):
                    got[r[2 + j] + 1] += (p if side == 0 else 1 - p) * r[6]
                rely[v][side] = [x / sum(got) for x in got]
    names = [*KINDS, "base", *VOTES]
    w = dict.fromkeys(names, 0.0)
    total = sum(r[6] for r in rows) or 1
    for _ in range(steps if rows else 0):
        slope = {k: 0.001 * w[k] for k in names}
        for p, r in zip(post, rows):
            x = {KINDS[r[0]]: 1.0, "base": float(r[1]), **dict(zip(VOTES, map(float, r[2:6])))}
            y = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                slope[k] += (y - p) * v * r[6] / total
        for k in names:
            w[k] -= 0.5 * slope[k]
    return Model({v: (tuple(a), tuple(b)) for v, (a, b) in rely.items()}, w)


def find(docs: DataFrame) -> tuple[DataFrame, Model]:
    """(doc_id, spans array<struct<kind, s, e, base, ...>>) for each row of documents(doc_id, text, ...), and the model.

    Places are code points, the end exclusive; spans stand by kind (email, ip, card, phone) and place.
    A null or empty text has none. Repeated rows and null doc_ids give rows of their own;
    other columns aren't looked at; an empty table gives no rows and a model that keeps the base alone.
    Nothing but counts of vote patterns is shuffled. Texts are read once; of them only candidates are written down.
    """
    cands = Tables(docs.sparkSession).write(candidates(docs))
    model = fit(cands)
    return cands.select("doc_id", F.expr(f"filter(cands, x -> {model.keep('x')})").alias("spans")), model


def digest(found: DataFrame) -> DataFrame:
    name = "element_at(array('email', 'ip', 'card', 'phone'), x.kind + 1)"
    base = "filter(spans, x -> x.base)"
    join = f"array_join(transform({{}}, x -> concat({name}, ':', x.s, ':', x.e)), ',')"
    counts = [f"cast(size(filter(spans, x -> x.base and x.kind = {k})) as long) n_{kind}" for k, kind in enumerate(KINDS)]
    return found.selectExpr("doc_id", *counts, f"sha2({join.format(base)}, 256) base_sha256", f"{join.format('spans')} spans")


#: Characters of the pieces that a text is cut into where places of it are looked up.
PIECE = 4096


def _between(lo: str, hi: str) -> str:
    """SQL for the characters from lo to hi of the text that pieces holds."""
    at, to = f"cast(({lo}) div {PIECE} as int)", f"cast(({hi}) div {PIECE} as int)"
    head, tail = f"substr(get(pieces, {at}), ({lo}) % {PIECE} + 1)", f"left(coalesce(get(pieces, {to}), ''), ({hi}) % {PIECE})"
    within = f"substr(get(pieces, {at}), ({lo}) % {PIECE} + 1, ({hi}) - ({lo}))"
    return f"if({hi} <= {lo}, '', if({at} = {to}, {within}, concat({head}, array_join(slice(pieces, {at} + 2, {to} - {at} - 1), ''), {tail})))"


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """The rows with each span, or run of overlapping spans, replaced by [KIND] of its first; n_chars, if there, follows the text.

    Null and empty texts stay as they are, repeated rows and rows without an id are rows like any other, columns may have any names,
    an empty table gives none. Candidates are found once and written down with their rows; the model, if none is given, is fitted on them. The work on a text
    is linear in its length and its spans.
    """
    columns = docs.columns
    own = {c: f"__{k}" for k, c in enumerate(columns)}  # names of our own, as the rows may have any
    whole = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in own.items() if c != text), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{text}`").isNull().alias("__null"))
    found = candidates(whole, tuple(whole.columns))
    if model is None:
        found = Tables(docs.sparkSession).write(found)
        model = fit(found)
    spans = f"array_sort(transform(filter(cands, x -> {model.keep('x')}), x -> struct(x.s as s, x.e as e, x.kind as kind)))"
    name = "element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]'), x.kind + 1)"
    ended = _running("transform(spans, x -> x.e)", "0", "greatest({a}, {x})")
    at = "if(i = 0, 0, get(ended, i - 1))"
    changed = f"transform(spans, (x, i) -> if(x.s < {at}, '', concat({_between(at, 'x.s')}, {name})))"
    rest = _between("element_at(ended, -1)", "length(text)")
    new = _let("ended", ended, _let("pieces", f"regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)", f"concat(array_join({changed}, ''), {rest})"))
    out = found.withColumn("spans", F.expr(spans)).withColumn("text", F.expr(f"if(size(spans) = 0, if(__null, null, text), {new})"))
    if "n_chars" in columns:
        n = own["n_chars"]
        out = out.withColumn(n, F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col(n)))
    return out.select(*(F.col("text" if c == text else k).alias(c) for c, k in own.items()))


__all__ = ["Model", "candidates", "digest", "find", "fit", "redact"]
