"""Personal data by weak supervision, with DataFrame functions only.

Four kinds have exact patterns; their spans are the base and always stay. Looser candidates (numbers
with separators, names after a form of address) are judged by labelers, each of which votes yes, no
or not at all on a span: a shape pattern, gazetteers of words that announce personal or impersonal
numbers, the personal data around it, the characters beside it, and the variety of its digits.

Nobody knows the labelers' reliabilities. The votes of all spans of the corpus, base ones too, are
counted by vote pattern, and expectation-maximisation over that table (as long as there are
patterns, whatever the corpus) estimates how each labeler votes on personal and other spans. Its
posteriors are the targets of the final span classifier, a logistic regression on votes and shape
that is fitted on the same counts and applied to every candidate as an expression.

All patterns take their runs whole with possessive quantifiers, start only where a run starts (or
where the last match ended), and so find what the plain patterns find, without backtracking over or
recursing into long runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("number", "person")
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+._%@-])[0-9]{2,5}(?:[\x20.()-]{1,2}[0-9]{2,5}){2,6}+(?![0-9A-Za-z%@])",
    "person": r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Herr|Frau|Madame|Monsieur|Señora?|Don|Doña)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
#: What a text must hold for its pattern to be tried at all.
_HINTS = {"email": "@", "phone": "+", "ip": "."}
_PERSONAL = "phone|tel|call|fax|mobile|contact|whatsapp|ssn|passport|iban|account|born|birth|name"
_IMPERSONAL = "isbn|issn|page|pages|version|order|invoice|figure|table|section|article|license|copyright|eur|usd|total"
AROUND, NEAR, ROUNDS, LABELERS = 24, 80, 60, ("shape", "gazetteer", "context", "beside", "digits")

_SPAN = "struct<start:int,end:int,found:string>"


#: Spans of a text that are added up, or searched, at once: work on a list of n grows as n * STEP + (n / STEP)**2.
STEP = 256


def _located(text: Column, pattern: str, found: Column) -> Column:
    """Offsets in code points of the matches ``found``, from the lengths of what lies between them.

    They are added up in groups, and the groups then moved to where they begin, as every step of a
    fold copies the list it has so far.
    """
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("x")))

    def step(acc: Column, y: Column) -> Column:
        begin = acc["at"] + y["gap"]
        end = begin + F.length(y["x"])
        span = F.struct(begin.alias("start"), end.alias("end"), y["x"].alias("found"))
        return F.when(y["x"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def group(first: Column) -> Column:
        return F.aggregate(F.slice(parts, first, F.lit(STEP)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def move(acc: Column, own: Column) -> Column:
        moved = F.transform(own["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["found"].alias("found")))
        return F.struct((acc["at"] + own["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    groups = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(STEP)), group)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{_SPAN}>>)").alias("out"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(groups, start, move, lambda acc: acc["out"]))).otherwise(none)


def _ranges(spans: Column) -> Column:
    """Spans sorted and cut into groups of ``STEP``, each with the range it covers, to be asked by ``_meets``."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(STEP)), lambda first: F.slice(ordered, first, F.lit(STEP)))
    return F.transform(parts, lambda own: F.struct(F.array_min(F.transform(own, lambda x: x["start"])).alias("lo"), F.array_max(F.transform(own, lambda x: x["end"])).alias("hi"), own.alias("own")))


def _meets(ranges: Column, start: Column, end: Column, other_than: Column | None = None) -> Column:
    """Whether a span in ``ranges`` overlaps start to end, one that begins at ``other_than`` aside."""

    def hit(x: Column) -> Column:
        found = (x["start"] < end) & (x["end"] > start)
        return found if other_than is None else found & (x["start"] != other_than)

    return F.exists(ranges, lambda g: F.when((g["lo"] < end) & (g["hi"] > start), F.exists(g["own"], hit)).otherwise(F.lit(False)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(value > 9, value - 9).otherwise(value)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_KEEP: dict[str, Callable[[Column], Column]] = {
    "ip": lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda x: _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def _votes(x: Column, text: Column, base: Column, is_base: bool) -> Column:
    """1 yes, 0 no, -1 no vote, for each labeler."""
    before = F.lower(F.substring(text, F.greatest(x["start"] + 1 - AROUND, F.lit(1)), F.least(x["start"], F.lit(AROUND))))
    digits = _digits(x["found"])
    n = F.length(digits)
    near = _meets(base, x["start"] - NEAR, x["end"] + NEAR, x["start"])
    beside = F.concat(F.substring(text, F.greatest(x["start"], F.lit(1)), F.least(x["start"], F.lit(1))), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(1)))
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    return F.struct(
        F.lit(1).alias("shape") if is_base else vote(n.between(9, 15) | (n == 0), n > 16).alias("shape"),
        vote(before.rlike(rf"(?<!\p{{L}})(?:{_PERSONAL})(?!\p{{L}})"), before.rlike(rf"(?<!\p{{L}})(?:{_IMPERSONAL})(?!\p{{L}})")).alias("gazetteer"),
        vote(near, F.lit(not is_base)).alias("context"),
        vote(beside.rlike(r"[<(\[:]"), beside.rlike(r"[$€£%=*/^_|]")).alias("beside"),
        vote((n > 0) & (F.size(F.array_distinct(F.split(digits, ""))) > 4), (n > 0) & (F.size(F.array_distinct(F.split(digits, ""))) < 3)).alias("digits"),
    )


def _shape(x: Column) -> Column:
    """Features for the final classifier, each with few values."""
    n = F.length(_digits(x["found"]))
    return F.struct(
        F.least((n / 4).cast("int"), F.lit(8)).alias("length"),
        F.least(F.length(F.regexp_replace(x["found"], r"[^\x20.()-]", "")), F.lit(4)).alias("breaks"),
        F.when(x["found"].contains("."), 1).otherwise(0).alias("dots"),
    )


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, base, more): arrays of (kind, start, end, votes, shape); more holds the candidates that overlap no base span."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.expr("cast(array() as array<string>)")
    for kind in KINDS + EXTRA:
        found = F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))
        hint = text.contains(_HINTS[kind]) if kind in _HINTS else F.lit(True)
        rows = rows.withColumn(f"m_{kind}", F.when(hint, found).otherwise(none))
    for kind in KINDS + EXTRA:
        rows = rows.withColumn(kind, _located(text, _PATTERNS[kind], F.col(f"m_{kind}")))
        if kind in _KEEP:
            keep = _KEEP[kind]
            rows = rows.withColumn(kind, F.filter(kind, lambda x: keep(x["found"])))  # called at once
    rows = rows.select("doc_id", "text", *KINDS, *EXTRA, _ranges(F.concat(*KINDS)).alias("all"))

    def described(kind: str) -> Column:
        free = F.col(kind)
        if kind in EXTRA:
            free = F.filter(free, lambda x: ~_meets(F.col("all"), x["start"], x["end"]))
        return F.transform(
            free, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(x, text, F.col("all"), kind in KINDS).alias("votes"), _shape(x).alias("shape"))
        )

    return rows.select("doc_id", F.concat(*map(described, KINDS)).alias("base"), F.concat(*map(described, EXTRA)).alias("more"))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[float, list[list[dict[int, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counted vote patterns: prior, each labeler's votes by class, posteriors.

    Starts from the share of yes votes; every estimate is smoothed by one pattern of each kind.
    """
    post = {v: (sum(x == 1 for x in v) + 0.5) / (sum(x >= 0 for x in v) + 1) for v, _ in patterns}
    prior, table = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        mass = [sum(n * (post[v] if c else 1 - post[v]) for v, n in patterns) for c in (0, 1)]
        prior = (mass[1] + 1) / (total + 2)
        table = [[{vote: (sum(n * (post[v] if c else 1 - post[v]) for v, n in patterns if v[i] == vote) + 1) / (mass[c] + 3) for vote in (-1, 0, 1)} for c in (0, 1)] for i in range(len(LABELERS))]
        for v, _ in patterns:
            log = [math.log(p) + sum(math.log(table[i][c][x]) for i, x in enumerate(v)) for c, p in ((0, 1 - prior), (1, prior))]
            post[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, log[0] - log[1]))))
    return prior, table, post


def _features(kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    return [1.0, float(kind == "person"), float(kind in KINDS), *[float(v == 1) for v in votes], *[float(v == 0) for v in votes], *[s / 4 for s in shape]]


def span_classifier(rows: list[tuple[list[float], float, float]], rounds: int = 200) -> list[float]:
    """Logistic regression on (features, target, count) by gradient steps with a small ridge."""
    weights = [0.0] * (len(rows[0][0]) if rows else 0)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for x, target, n in rows:
            p = 1 / (1 + math.exp(max(-700.0, min(700.0, -sum(w * v for w, v in zip(weights, x, strict=True))))))
            for j, v in enumerate(x):
                if v:
                    slope[j] += n / total * (p - target) * v
        weights = [w - 2.0 * g for w, g in zip(weights, slope, strict=True)]
    return weights


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): one row per row of ``docs`` with its spans as (kind, start, end), by kind, then start.

    ``base`` holds the kinds of KINDS, ``added`` those of EXTRA that the classifier gives at least
    one half. Offsets are code points, the end exclusive. A null text is empty and has no spans; null
    ids and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    spans = scratch.save(found_spans(docs, id_col, text_col), "spans")
    counted = spans.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.kind", "x.votes", "x.shape").count().collect()
    tally = [(r["kind"], tuple(r["votes"]), tuple(r["shape"]), float(r["count"])) for r in sorted(counted, key=str)]
    by_votes: dict[tuple[int, ...], float] = {}
    for _, votes, _, n in tally:
        by_votes[votes] = by_votes.get(votes, 0.0) + n
    _, _, post = reliabilities(sorted(by_votes.items()))
    weights = span_classifier([(_features(k, v, s), 1.0 if k in KINDS else post[v], n) for k, v, s, n in tally])

    def score(x: Column) -> Column:
        parts = [F.lit(1.0), (x["kind"] == "person").cast("double"), F.lit(0.0)]
        parts += [(x["votes"][name] == vote).cast("double") for vote in (1, 0) for name in LABELERS]
        parts += [x["shape"][name] / 4 for name in ("length", "breaks", "dots")]
        return sum((F.lit(w) * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))

    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    added = F.filter("more", lambda x: score(x) >= 0) if weights else F.filter("more", lambda x: F.lit(False))
    return spans.select("doc_id", F.transform("base", plain).alias("base"), F.transform(added, plain).alias("added"))
