"""Personal data by weak supervision (native).

Candidates are the matches of the strict patterns (base spans, which always stay), and of wider ones: e-mail addresses
spelt with "at" and "dot", long IP addresses, card-like numbers that fail the check digit, phone numbers without a
country code, and long runs of letters and digits that may be secrets (access tokens, keys). Four labelers vote on
every candidate, for it, against it, or not at all: the rule of its kind (regex), a gazetteer (top-level domains,
calling codes, issuer prefixes, reserved networks, well-known token forms), the words just before it (context, with
words that speak against it), and its shape.

Expectation-maximisation over the counts of all vote patterns of the corpus estimates how reliable each labeler is for
each kind (shrunk toward its rates over all kinds) and the posterior of each pattern; an abstention says nothing. On
those posteriors a logistic span classifier is trained, which sees, besides the votes, what no labeler looks at:
separators, variety of characters, length, whether the candidate stands alone and whether it is quoted, each of them
for its kind. The classifier then decides on the candidates that are not base spans; of those it takes, none may
overlap an earlier one, and one for which neither rule nor context has voted is left out, so that bare numbers in clean
documents stay alone. Votes, features, spans and scores are Column expressions; only the table of counts, at most
5 x 3^4 x 108 rows whatever the corpus, reaches the driver.

Positions are code points, ends exclusive. Defined results: null text counts as empty; a text without candidates has
no spans. Very long texts and runs are safe: the patterns are possessive and anchored at the start of runs, so they
neither backtrack nor recurse. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

#: The kinds of base spans, and of all.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Patterns: kind, whether strict, what a text must contain to be searched (a character or a pattern), the pattern. Fixed by the contract (strict
#: ones, written so that they cannot backtrack) or wider than it.
PATTERNS = {
    "email": ("email", True, "@",
              r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("card", True, "(?:[0-9][ -]?){5}[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "spelt": ("email", False, r"(?i)[ (\[]at[ )\]]",
              r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)"),
    "local": ("phone", False, "[0-9][ .-][0-9]",
              r"(?<![0-9+.-])(?<![0-9] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-])(?![. ][0-9])"),
    "long_ip": ("ip", False, "[0-9A-Fa-f]:[0-9A-Fa-f]",
                r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    "secret": ("secret", False, "[A-Za-z0-9_+/=-]{20}", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
}
#: What the gazetteer knows, by kind, and what it says of the rest.
KNOWN = {
    "email": (r"[. )\]](com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at)$", 0),
    "ip": (r"^(?!0+\.|10\.|127\.|22[4-9]\.|2[3-5][0-9]\.)", 0),
    "card": (r"^(3[47]|30|36|38|4|5[1-5]|2[2-7]|6)", 0),
    "phone": (r"^\+?\(?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|0)", 0),
    "secret": (r"^(akia|asia|aiza|gh[opsu]_|github_pat_|glpat-|sk[-_]|pk_live_|xox[abps]-|eyj|ya29)|^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", 2),
}
#: Words before a candidate that speak for it, and against it.
CUES = {
    "email": (r"(?i)(mail|contact|write|kontakt|correo|courriel)", r"(?i)(meet|look|arrive|start)\w*\W*$"),
    "ip": (r"(?i)(\bip\b|host|server|addr|proxy)", r"(?i)(version|release|section|\bv)\W*$"),
    "card": (r"(?i)(card|carte|karte|tarjeta|visa|credit)", r"(?i)(order|invoice|isbn|tracking|serial|\bid)\W*$"),
    "phone": (r"(?i)(tel|phone|call|fax|mobil|appel|ruf|llam)", r"(?i)(order|invoice|isbn|tracking|serial|part|\bid)\W*(no|number|nr)?\W*$"),
    "secret": (r"(?i)(token|secret|passw|passwd|pwd|api.?key|credential|bearer|private.?key)", r"(?i)(commit|sha-?[0-9]*|md5|checksum|hash|digest|uuid|https?)\W*$"),
}
SHAPES = {
    "email": r"^[A-Za-z0-9].{0,80}$",
    "ip": r"^[0-9A-Fa-f.:]{7,39}$",
    "card": r"^([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})$",
    "phone": r"^\+?[0-9]{0,3}[ .-]?(\([0-9]{1,5}\)|[0-9]{1,5})([ .-]?[0-9]{2,5}){1,4}$",
    "secret": r"^(?=.{20,200}$)(?=(?:[^0-9]*[0-9]){3})(?![A-Za-z]*[-_/][A-Za-z]+[-_/])",
}
#: Least probability of a span that is not a base span; characters of context; strength of the shrinkage of the rates.
LEAST, BEFORE, PULL = 0.9, 24, 20.0
#: How many values each feature has.
VALUES = (3, 3, 3, 2, 2)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = _digits(x)
    twice = "if(d * 2 > 9, d * 2 - 9, d * 2)"
    walk = f"transform(split(reverse({d}), ''), (c, i) -> cast(c as int))"
    walk = f"transform({walk}, (d, i) -> if(i % 2 = 1, {twice}, d))"
    return f"aggregate({walk}, 0, (a, d) -> a + coalesce(d, 0)) % 10 = 0"


def _strict(kind: str, x: str) -> str:
    """Whether a match of the strict pattern counts."""
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    if kind == "card":
        return f"if(length({_digits(x)}) between 12 and 19, {_luhn(x)}, false)"
    if kind == "phone":
        return f"length({_digits(x)}) between 9 and 15"
    return "true"


def _keep(name: str, x: str) -> str:
    """Which matches that are no base spans are candidates."""
    return {
        "card": f"length({_digits(x)}) between 12 and 19", "spelt": "true", "local": "true", "long_ip": "true",
        "secret": f"({x} rlike '[0-9]' and {x} rlike '[A-Za-z]')",
    }.get(name, "false")


def _rule(name: str, x: str, before: str, ok: str) -> str:
    """The vote of the rule of a pattern."""
    bracketed, assigned = _sql(r"(?i)[(\[]at[)\]]"), _sql(r"[=:] *[\"'`]?$")
    return {
        "spelt": f"if({x} rlike {bracketed}, 1, 2)", "local": "2", "long_ip": "1", "secret": f"if({before} rlike {assigned}, 1, 2)",
    }.get(name, f"cast({ok} as int)")


def _found(name: str) -> str:
    """SQL: the candidates of one pattern, from its gaps g_ and hits h_."""
    kind, strict, _, _ = PATTERNS[name]
    g, h, k = f"g_{name}", f"h_{name}", KINDS.index(kind)
    start, before = f"acc.p + length({g}[i])", f"right({g}[i], {BEFORE})"
    ok = _strict(kind, f"{h}[i]") if strict else "false"
    item = (
        f"named_struct('s', {start}, 'k', {k}, 'e', {start} + length({h}[i]), 'base', {ok}, 'x', {h}[i],"
        f" 'b', {before}, 'a', left({g}[i + 1], 1))"
    )
    kind_of = "array<struct<s:int,k:int,e:int,base:boolean,x:string,b:string,a:string>>"
    step = f"named_struct('p', {start} + length({h}[i]), 'o', array_append(acc.o, {item}))"
    first = f"named_struct('p', 0, 'o', cast(array() as {kind_of}))"
    walked = f"aggregate(sequence(0, size({h}) - 1), {first}, (acc, i) -> {step}, acc -> acc.o)"
    wanted = f"filter({walked}, c -> c.base or {_keep(name, 'c.x')})"
    ruled = f"transform({wanted}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'base', c.base, 'x', c.x, 'b', c.b, 'a', c.a, 'r', {_rule(name, 'c.x', 'c.b', 'c.base')}))"
    kind_of = kind_of.replace(">>", ",r:int>>")
    return f"if({h} is null or size({h}) = 0, cast(array() as {kind_of}), {ruled})"


def _case(on: list[str]) -> str:
    return "case c.k " + " ".join(f"when {i} then {x}" for i, x in enumerate(on)) + " end"


def _votes() -> str:
    """SQL: the votes of the labelers on a candidate, 1 for, 0 against, 2 abstaining."""
    known = _case([f"if(lower(c.x) rlike {_sql(p)}, 1, {other})" for p, other in (KNOWN[k] for k in KINDS)])
    context = _case([f"if(c.b rlike {_sql(yes)}, 1, if(c.b rlike {_sql(no)}, 0, 2))" for yes, no in (CUES[k] for k in KINDS)])
    shape = _case([f"if(c.x rlike {_sql(SHAPES[k])}, 1, 0)" for k in KINDS])
    return f"array(c.r, {known}, {context}, {shape})"


def _features() -> str:
    """SQL: separators (none, one kind, several), variety of characters, length, standing alone, quoted."""
    apart = "size(array_distinct(regexp_extract_all(c.x, '[^A-Za-z0-9]', 0)))"
    kinds = "size(array_distinct(split(lower(c.x), '')))"
    alone = "cast(not (c.a rlike '[A-Za-z0-9]') and not (right(c.b, 1) rlike '[A-Za-z0-9]') as int)"
    opens, closes = _sql(r"[\"'`(\[]"), _sql(r"[\"'`)\]]")
    quoted = f"cast(c.a rlike {closes} and right(c.b, 1) rlike {opens} as int)"
    return f"array(least({apart}, 2), if({kinds} < 5, 0, if({kinds} < 10, 1, 2)), if(length(c.x) < 12, 0, if(length(c.x) <= 20, 1, 2)), {alone}, {quoted})"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: candidates {s, k, e, base, v, f} (start, kind's number, end, base or not, votes, features) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for name, (_, _, gate, pattern) in PATTERNS.items():
        gate, p = f"contains(t, {_sql(gate)})" if len(gate) == 1 else f"t rlike {_sql(gate)}", _sql(pattern)
        rows = rows.withColumn(f"g_{name}", F.expr(f"if({gate}, split(t, {p}, -1), null)"))
        rows = rows.withColumn(f"h_{name}", F.expr(f"if({gate}, regexp_extract_all(t, {p}, 0), null)"))
    rows = rows.withColumn("strict", F.expr("concat(" + ", ".join(_found(n) for n in PATTERNS if PATTERNS[n][1]) + ")"))
    rows = rows.withColumn("wide", F.expr("concat(" + ", ".join(_found(n) for n in PATTERNS if not PATTERNS[n][1]) + ")"))
    clear = "filter(concat(strict, wide), c -> c.base or not exists(strict, o -> o.base and o.s < c.e and c.s < o.e))"
    slim = f"transform({clear}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'base', c.base, 'v', {_votes()}, 'f', {_features()}))"
    return rows.select("doc_id", F.expr(f"array_sort({slim})").alias("found"))


Row = tuple[int, tuple[int, ...], tuple[int, ...], float]  # kind, votes, features, count


def estimate(table: Iterable[Row], rounds: int = 100) -> tuple[dict, dict]:
    """Expectation-maximisation: the posterior of each (kind, votes), and rates[kind, labeler] = P(1 | true), P(1 | false).

    A labeler that abstains adds nothing; its rates for a kind are shrunk toward its rates over all kinds by PULL votes.
    """
    counts: dict[tuple[int, tuple[int, ...]], float] = {}
    for k, votes, _, c in table:
        counts[k, votes] = counts.get((k, votes), 0.0) + c
    kinds = sorted({k for k, _ in counts})
    labelers = range(len(next(iter(counts))[1]) if counts else 0)
    rates = {(k, i): [0.8, 0.2] for k in kinds for i in labelers}
    prior = {k: 0.5 for k in kinds}
    post: dict = {}
    for _ in range(rounds):
        for k, votes in counts:
            a, b = prior[k], 1 - prior[k]
            for i, v in enumerate(votes):
                if v < 2:
                    a, b = (a * r if v else a * (1 - r) for a, r in zip((a, b), rates[k, i], strict=True))
            post[k, votes] = a / (a + b)
        for k in kinds:
            mine = [(post[key], c) for key, c in counts.items() if key[0] == k]
            prior[k] = (1 + sum(p * c for p, c in mine)) / (2 + sum(c for _, c in mine))
        for i in labelers:
            heard = [(k, votes[i], post[k, votes], c) for (k, votes), c in counts.items() if votes[i] < 2]
            for side in (0, 1):
                share = [(k, v, c * (1 - p if side else p)) for k, v, p, c in heard]
                whole = ((0.2 if side else 0.8) * 5 + sum(c for _, v, c in share if v)) / (5 + sum(c for *_, c in share))
                for k in kinds:
                    own = [(v, c) for q, v, c in share if q == k]
                    rate = (whole * PULL + sum(c for v, c in own if v)) / (PULL + sum(c for _, c in own))
                    rates[k, i][side] = min(0.999, max(0.001, rate))
    return post, rates


def _row(k: int, votes: tuple[int, ...], features: tuple[int, ...]) -> list[float]:
    """1, kinds, votes as +1, -1, 0, and each feature's values but the first, for all kinds and for this one."""
    kinds = [float(k == i) for i in range(len(KINDS))]
    values = [float(f == v) for f, n in zip(features, VALUES, strict=True) for v in range(1, n)]
    return [1.0, *kinds, *({1: 1.0, 0: -1.0, 2: 0.0}[v] for v in votes), *values, *(q * v for q in kinds for v in values)]


def train(table: list[Row], least_ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier: a ridge logistic regression on the posteriors, by Newton steps."""
    width = len(_row(0, (2,) * 4, (0,) * len(VALUES)))
    w = np.zeros(width)
    if not table:
        return w
    post, _ = estimate(table)
    x = np.array([_row(k, v, f) for k, v, f, _ in table])
    y = np.array([post[k, v] for k, v, _, _ in table])
    n = np.array([c for *_, c in table])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + least_ridge * np.eye(width), x.T @ (n * (p - y)) + least_ridge * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def votes_table(found: DataFrame) -> list[Row]:
    """Counts of all (kind, votes, features); their number has a bound that does not depend on the corpus."""
    each = found.select(F.explode("found").alias("c")).groupBy(F.col("c.k").alias("k"), F.col("c.v").alias("v"), F.col("c.f").alias("f")).count()
    return sorted((r["k"], tuple(r["v"]), tuple(r["f"]), float(r["count"])) for r in each.collect())


def score_sql(weights: np.ndarray) -> str:
    """SQL: the classifier's logit of a candidate c."""
    w = [float(x) for x in weights]
    n, wide = len(KINDS), sum(VALUES) - len(VALUES)
    votes, common, own = 1 + n, 1 + n + 4, 1 + n + 4 + wide
    parts = [f"array({', '.join(f'{w[0] + w[1 + k]!r}D' for k in range(n))})[c.k]"]
    parts += [f"array({-w[votes + i]!r}D, {w[votes + i]!r}D, 0D)[c.v[{i}]]" for i in range(4)]
    at = 0
    for j, values in enumerate(VALUES):
        table = [0.0 if v == 0 else w[common + at + v - 1] + w[own + k * wide + at + v - 1] for k in range(n) for v in range(values)]
        parts.append(f"array({', '.join(f'{x!r}D' for x in table)})[c.k * {values} + c.f[{j}]]")
        at += values - 1
    return " + ".join(parts)


def spans(found: DataFrame, weights: np.ndarray, least: float = LEAST) -> DataFrame:
    """found reduced to base spans and to the others whose probability is at least `least`."""
    likely = f"(c.v[0] = 1 or c.v[2] = 1) and {score_sql(weights)} >= {math.log(least / (1 - least))!r}D"
    rows = found.withColumn("found", F.expr(f"filter(found, c -> c.base or ({likely}))"))
    before = "not o.base and o.s < c.e and c.s < o.e and (o.s < c.s or o.s = c.s and (o.e > c.e or o.e = c.e and o.k < c.k))"
    return rows.withColumn("found", F.expr(f"filter(found, c -> c.base or not exists(found, o -> {before}))"))


def _joined(only_base: bool) -> Column:
    names = "array(" + ", ".join(map(_sql, KINDS)) + ")"
    chosen = "filter(found, c -> c.base)" if only_base else "found"
    return F.expr(f"array_join(transform({chosen}, c -> concat({names}[c.k], ':', c.s, ':', c.e)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all) for every row of docs."""
    found = cut(candidates(docs))
    out = spans(found, train(votes_table(found)))
    counts = [F.expr(f"cast(size(filter(found, c -> c.base and c.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"), F.size("found").cast("long").alias("n_spans")
    )
