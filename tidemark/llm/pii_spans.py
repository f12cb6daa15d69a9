"""Personal data by weak supervision, in DataFrame operations.

Regular expressions find base spans, which always stay, and looser candidates. Five labelers (shape,
structure, gazetteer, context words, boundaries) vote for, against or not at all on every span.
Expectation-maximisation over the counts of vote patterns (a table of at most 4 * 3**5 rows, however large
the input) estimates how reliable each labeler is for each kind, and its posteriors train a logistic
span classifier whose weights are applied as a column expression. Candidates that it accepts and that
touch no base span of their kind are added.

Texts are read once: matches come from ``regexp_extract_all`` and their offsets from the lengths of
``split``'s pieces. Possessive quantifiers and anchors at run starts keep the regexes linear in long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# \\G: a match may start where the last one ended; else only at the start of a run.
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9]){15,}+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: Something that every match holds: texts without it skip the expression.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CANDIDATE = (
    "\\b[A-Za-z0-9._%+-]{1,64}+ ?(?:\\[at\\]|\\(at\\)) ?[A-Za-z0-9-]{1,63}+ ?(?:\\[dot\\]|\\(dot\\)|\\.) ?[A-Za-z]{2,12}\\b"
    "|(?<![0-9A-Za-z+.-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
    "|(?<![0-9A-Za-z.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z-])"
    "|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
)
# Gazetteers and context words.
TLDS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|ch|at|it|nl|example|test"
CALLING = "1|33|34|39|41|43|44|49|351|352|353|358|420|48|7|81|82|86|91|52|54|55|56|57"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
CONTEXT = {
    "email": "mail|contact|write|correo|courriel|kontakt",
    "ip": "\\bip\\b|host|server|address|adresse|direcci",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|fax|mobil|anruf|appel|llama",
}
CONTEXT_CHARS = 40
LABELERS = ("shape", "structure", "gazetteer", "context", "boundary")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    chars = F.split(F.reverse(digits), "")

    def term(x, i):
        d = x.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.filter(chars, lambda x: x != ""), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, start: Column, step) -> Column:
    """Running folds of an array, each element's own included, in blocks of its root so that little is copied.

    ``step(a, b)`` must be associative with ``start`` neutral.
    """
    def fold(block, first):
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, begin, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    def blocks(v, size):
        n = F.ceil(F.size(v) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * size + 1, size))

    def all_(v):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return _let(blocks(v, size), lambda parts: _let(fold(F.transform(parts, lambda p: F.aggregate(p, start, step)), start), lambda ends: F.flatten(
            F.transform(parts, lambda p, i: fold(p, F.when(i == 0, start).otherwise(F.get(ends, i - 1)))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, all_(v)).otherwise(F.array().cast("array<int>")))


_LOCATED = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def _located(found: Column, pieces: Column) -> Column:
    """Spans from the matches and the pieces around them, each with up to ``CONTEXT_CHARS`` before it and one character after.

    The text before a span reaches back over one match at most.
    """
    none = F.array().cast(_LOCATED)

    def spans(m, p, ends):
        def one(i):
            s, end = F.get(m, i), F.get(ends, i)
            tail = lambda c: F.coalesce(F.when(i > 0, F.right(c, F.lit(CONTEXT_CHARS))), F.lit(""))
            before = F.concat(tail(F.get(p, i - 1)), tail(F.get(m, i - 1)), F.right(F.get(p, i), F.lit(CONTEXT_CHARS)))
            after = F.concat(F.left(F.get(p, i + 1), F.lit(1)), F.coalesce(F.left(F.get(m, i + 1), F.lit(1)), F.lit("")))
            return F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("s"), F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), F.left(after, F.lit(1)).alias("after"))

        return F.transform(F.sequence(F.lit(0), F.size(m) - 1), one)

    def placed(m):
        def in_pieces(p):
            sizes = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(p, i)))
            return _let(running(sizes, F.lit(0), lambda a, x: a + x), lambda ends: spans(m, p, ends))

        return F.when(F.size(m) > 0, _let(pieces, in_pieces)).otherwise(none)

    return F.coalesce(_let(found, placed), none)


def _apart(loose: Column, base: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``base``; one sort and two running folds, not all pairs."""
    def kept(all_):
        ends = running(F.transform(all_, lambda x: F.when(x["base"], x["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        starts = running(F.transform(F.reverse(all_), lambda x: F.when(x["base"], x["start"]).otherwise(2**31 - 1)), F.lit(2**31 - 1), lambda a, x: F.least(a, x))
        return _let(ends, lambda e: _let(starts, lambda s: F.filter(all_, lambda x, i: ~x["base"] & (F.get(e, i) <= x["start"]) & (F.get(s, F.size(all_) - 1 - i) >= x["end"]))))

    # A base span that begins where a candidate does comes first.
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["base"] == y["base"], 0).when(x["base"], -1).otherwise(1)
    return F.when(F.size(loose) == 0, loose).otherwise(_let(F.array_sort(F.concat(loose, base), order), kept))


def _kind(s: Column) -> Column:
    return F.when(s.rlike("(?i)[\\[(]at"), "email").when(s.contains(":"), "ip").when(F.length(_digits(s)) == 15, "card").otherwise("phone")


def _votes(kind: Column, base: Column, s: Column, before: Column, after: Column) -> Column:
    """The labelers' votes as struct of ints: 1 for, 0 against, 2 none."""
    by = lambda f: F.when(kind == "email", f("email")).when(kind == "ip", f("ip")).when(kind == "card", f("card")).otherwise(f("phone"))
    bit = lambda c: F.when(c, 1).otherwise(0)
    d = _digits(s)
    structure = by(lambda k: {"email": bit(s.rlike("^[A-Za-z0-9]") & ~s.rlike("\\.\\.")), "ip": bit(~s.rlike("(^|\\.)0[0-9]")), "card": bit(luhn(d)), "phone": bit(F.length(d).between(9, 13))}[k])
    place = by(lambda k: {"email": bit(s.rlike(f"(?i)[.)\\]] ?({TLDS})$")), "ip": F.when(s.rlike("^(0|255|224)\\."), 0).otherwise(2), "card": bit(d.rlike(f"^({ISSUERS})")), "phone": F.when(s.startswith("+"), bit(d.rlike(f"^({CALLING})"))).otherwise(2)}[k])
    context = by(lambda k: F.when(before.rlike(f"(?i){CONTEXT[k]}"), 1).otherwise(2))
    boundary = bit(~before.rlike("[0-9A-Za-z]$") & ~after.rlike("^[0-9A-Za-z]"))
    return F.struct(F.when(base, 1).otherwise(2).alias("shape"), structure.alias("structure"), place.alias("gazetteer"), context.alias("context"), boundary.alias("boundary"))


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``spans``: array of struct(kind, start, end, base, votes), base spans and candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("__t"))
    pattern = {**BASE, "loose": CANDIDATE}

    def found(k):
        m = F.regexp_extract_all("__t", F.lit(pattern[k]), F.lit(0))
        need = _NEEDS.get(k, "")
        return F.when(F.col("__t").contains(need), m).otherwise(F.array().cast("array<string>")) if need else m

    df = df.withColumns({f"__m_{k}": found(k) for k in pattern})
    df = df.withColumns({f"__s_{k}": _located(F.col(f"__m_{k}"), F.split("__t", pattern[k], -1)) for k in pattern})

    def full(x, kind, base):
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), _votes(kind, base, x["s"], x["before"], x["after"]).alias("votes"))

    def valid(k):
        return F.transform(F.filter(f"__s_{k}", lambda x: _valid(k, x["s"])), lambda x: full(x, F.lit(k), F.lit(True)))

    strict = [valid(k) for k in KINDS]
    loose = F.transform("__s_loose", lambda x: full(x, _kind(x["s"]), F.lit(False)))
    spans = _let(F.concat(*strict), lambda base: F.concat(base, _apart(loose, base)))
    return df.select(*keep, spans.alias("spans"))


def vote_counts(spans: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, votes, count) over all spans: at most 4 * 3**5 rows."""
    rows = spans.select(F.explode("spans").alias("x")).groupBy("x.kind", *(F.col(f"x.votes.{v}").alias(v) for v in LABELERS)).count().collect()
    return sorted((r["kind"], tuple(r[v] for v in LABELERS), r["count"]) for r in rows)


def estimate(counts, rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a span is personal data, for each kind and vote pattern, by EM over the labelers."""
    post = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in counts if k == kind]
        p = {v: min(0.95, max(0.05, (1 + sum(x == 1 for x in v)) / (2 + sum(x != 2 for x in v)))) for v, _ in own}
        for _ in range(rounds):
            pos = sum(n * p[v] for v, n in own) + 1
            neg = sum(n * (1 - p[v]) for v, n in own) + 1
            rate = {}
            for i in range(len(LABELERS)):
                for x in (0, 1):  # smoothed towards labelers that are better than chance
                    said = [(p[v], n, v[i]) for v, n in own if v[i] != 2]
                    rate[i, 1, x] = (sum(n * q for q, n, y in said if y == x) + (4 if x else 1)) / (sum(n * q for q, n, _ in said) + 5)
                    rate[i, 0, x] = (sum(n * (1 - q) for q, n, y in said if y == x) + (1 if x else 4)) / (sum(n * (1 - q) for q, n, _ in said) + 5)
            for v, _ in own:
                odds = math.log(pos / neg) + sum(math.log(rate[i, 1, x] / rate[i, 0, x]) for i, x in enumerate(v) if x != 2)
                p[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        post |= {(kind, v): q for v, q in p.items()}
    return post


def _inputs(kind: str, votes) -> list[tuple]:
    return [("kind", kind), *((kind, i, x) for i, x in enumerate(votes) if x != 2)]


def train(counts, post, rounds: int = 300, rate: float = 0.5) -> dict[tuple, float]:
    """Weights of the span classifier: logistic regression on votes by kind, against the posteriors."""
    total = sum(n for *_, n in counts) or 1
    rows = [(_inputs(k, v), post[k, v], math.sqrt(n / total)) for k, v, n in counts]
    w: dict[tuple, float] = {f: 0.0 for x, *_ in rows for f in x}
    for _ in range(rounds):
        grad = dict.fromkeys(w, 0.0)
        for x, q, n in rows:
            e = n * (q - 1 / (1 + math.exp(-max(-30, min(30, sum(w[f] for f in x))))))
            for f in x:
                grad[f] += e
        for f in w:
            w[f] += rate * (grad[f] - 1e-3 * w[f])
    return w


def accepts(x: Column, weights: dict[tuple, float]) -> Column:
    """Whether the classifier takes a span."""
    z = F.lit(0.0)
    for f, w in sorted(weights.items(), key=str):
        on = (x["kind"] == f[1]) if f[0] == "kind" else (x["kind"] == f[0]) & (x["votes"][LABELERS[f[1]]] == f[2])
        z = z + F.when(on, F.lit(w)).otherwise(0.0)
    return z >= 0


def detect_pii(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) and ``spans``: array of struct(kind, start, end, base), in code points.

    Ordered by kind as in ``KINDS``, then start. Null and empty texts have none; repeated rows are judged alike.
    """
    keep = keep or ["doc_id"]
    spans = materialize(find_spans(docs, keep), "spans")
    counts = vote_counts(spans)
    weights = train(counts, estimate(counts))
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    stay = F.filter("spans", lambda x: x["base"] | accepts(x, weights))
    ordered = F.array_sort(F.transform(stay, lambda x: F.struct(rank[x["kind"]].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return spans.select(*keep, F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
