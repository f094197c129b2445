"""Personal data: base patterns and a span classifier from weak supervision.

Candidates are looser than the base patterns: anything with an @ sign between
words, and groups of at least seven digits. Each is of one kind by its form:
mail, dotted quad, long number or telephone number. Labelers vote for or against
each candidate or abstain: patterns, a checksum, gazetteers of domains and
dialling codes, words before the candidate, and its neighbouring characters.
Equal vote patterns are counted over all documents; expectation-maximisation
over these counts estimates for each kind how reliable each labeler is, and the
posteriors train a logistic classifier of votes and shape for each kind.
Labelers of different kinds never vote together, so one estimate for all kinds
could take a whole kind for the other class; here a labeler is at worst without
weight, never taken for its opposite. Candidates that the classifier accepts and
no base span covers are reported as kind `model`.

All of it is column expressions. Only vote patterns, of which there are at most
`PATTERNS`, reach the driver. Positions are code points, ends exclusive. The
patterns are possessive and start at run boundaries, so they are linear in the
text and never recurse.

A null text counts as empty. A very long text is one row of one task, with its
spans as an array. Overlapping spans are all listed; a score equal to the
threshold is accepted. Repeated rows are judged one by one and all count in the
estimates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import free_name
from panelspark.runtime import bounded_rows

KINDS = ("email", "ip", "card", "phone")
#: (may occur in the text, pattern); \G lets a match begin right behind the last one, as a search does.
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = (r"[0-9@]", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++"
                    r"|\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Gazetteers: ends of mail domains; dialling codes.
DOMAINS = r"\.(?:com|net|org|edu|gov|info|io|co|eu|de|fr|es|uk|it|nl|ch|at|us)$"
DIALLING = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1246]|9[0-5])(?![0-9]{12})"
#: Words before a candidate that speak for or against it (English, German, French, Spanish).
NEAR_YES = (r"(?i)\b(?:e-?mail|mail|correo|courriel|phone|tel|telefon|mobile|handy|fax|call|contact|kontakt|card|visa|karte|"
            r"carte|tarjeta|iban|ip|host|server)\b[^A-Za-z]{0,4}\w{0,12}[^A-Za-z]{0,4}$")
NEAR_NO = r"(?i)(?:\b(?:version|isbn|page|seite|order|invoice|total|price|token|key|hash|id|eur|usd)\b[^A-Za-z]{0,4}|[$€£#]\s?)$"
#: Forms of telephone numbers without a country code: a leading 0, or groups of 3, 3 and 4 digits.
LOCAL = r"^\(?0[1-9]|^\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}$"
#: Each kind has few labelers, and votes are -1, 0 or 1: 3 ** labelers x shapes is far below this.
PATTERNS = 60_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a text of digits holds."""
    back = F.reverse(digits)
    weights = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(back, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(weights, F.lit(0), lambda a, b: a + b) % 10 == 0


def matches(text: Column, may: str, pattern: str) -> Column:
    """Array of (start, end, value) of the non-overlapping matches, from the left."""
    empty = F.lit(0), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"),
                        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    zero = F.struct(empty[0].cast("bigint").alias("at"), empty[1].alias("out"))
    found = F.aggregate(cut, zero, step, lambda acc: acc["out"])
    return F.when(F.coalesce(text.rlike(may), F.lit(False)), found).otherwise(empty[1])


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
        "card": F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(False),
        "phone": (n >= 9) & (n <= 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) by kind as listed, then start."""
    def of(kind: str) -> Column:
        good = F.filter(matches(text, *BASE[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*map(of, KINDS))


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.otherwise(0) if no is None else vote.when(no, -1).otherwise(0)).cast("int")


def _labelers(value: Column, left: Column, right: Column) -> tuple[Column, dict[str, Column]]:
    """The kind of a candidate and the vote of each labeler; those of other kinds abstain."""
    digits = _digits(value)
    n, plus = F.length(digits), value.startswith("+")
    kind = (F.when(value.contains("@"), "mail").when((n < 13) & value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "quad")
            .when(plus | value.startswith("(") | (n < 13), "telephone").otherwise("number"))
    mail, quad, phone, number = (kind == k for k in FORMS)
    numbers = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    checked = F.exists(F.concat(F.array(digits), numbers), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    glued = left.rlike(r"[A-Za-z0-9_]$") | right.rlike(r"^[A-Za-z0-9_%]")
    return kind, {
        "mail_pattern": _vote(mail & value.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"), mail),
        "quad_pattern": _vote(quad & value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), quad),
        "checksum": _vote(number & checked, number),
        "phone_pattern": _vote(phone & n.between(9, 15) & (plus | value.rlike(LOCAL)), phone),
        "domain_gazetteer": _vote(mail & value.rlike(DOMAINS), mail),
        "dialling_gazetteer": _vote(phone & plus & value.rlike(DIALLING), phone & plus),
        "words_before": _vote(left.rlike(NEAR_YES), left.rlike(NEAR_NO)),
        "neighbours": _vote(F.lit(False), glued),
    }


#: Kinds of candidates.
FORMS = ("mail", "quad", "telephone", "number")
LABELERS = ("mail_pattern", "quad_pattern", "checksum", "phone_pattern", "domain_gazetteer", "dialling_gazetteer", "words_before", "neighbours")
#: Shape of a candidate: digits in four steps, and whether it has separators.
SHAPES = ("few_digits", "some_digits", "many_digits", "separated")


def candidates(text: Column) -> Column:
    """Array of candidates: start, end, kind, and their votes and shape."""

    def judged(m: Column) -> Column:
        value, left = m["value"], F.substring(text, F.greatest(m["start"] - 39, F.lit(1)).cast("int"), F.least(m["start"], F.lit(40)).cast("int"))
        right = F.substring(text, (m["end"] + 1).cast("int"), F.lit(2))
        form, votes = _labelers(value, left, right)
        n = F.length(_digits(value))
        shape = {"few_digits": n < 7, "some_digits": (n >= 7) & (n < 13), "many_digits": n >= 13, "separated": value.rlike(r"[\x20()./-]")}
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), form.alias("form"), *[votes[v].alias(v) for v in LABELERS],
                        *[shape[s].cast("int").alias(s) for s in SHAPES])

    return F.transform(matches(text, *LOOSE), judged)


@dataclass
class FormModel:
    """Of one kind of candidate: per labeler the chance of a yes for personal and for other data, given that it votes; and the classifier."""

    reliabilities: dict[str, tuple[float, float]]
    weights: dict[str, float]
    bias: float

    def log_odds(self, candidate: Column) -> Column:
        score = F.lit(self.bias)
        for name in LABELERS:
            score = score + F.when(candidate[name] == 1, F.lit(self.weights[name + "+"])).when(
                candidate[name] == -1, F.lit(self.weights[name + "-"])).otherwise(F.lit(0.0))
        for name in SHAPES:
            score = score + candidate[name] * F.lit(self.weights[name])
        return score


@dataclass
class SpanModel:
    """One model per kind of candidate; kinds without any candidate have none and accept nothing."""

    forms: dict[str, FormModel]
    threshold: float

    def accepts(self, candidate: Column) -> Column:
        score = F.lit(None).cast("double")
        for form, model in self.forms.items():
            score = F.when(candidate["form"] == form, model.log_odds(candidate)).otherwise(score)
        return F.coalesce(1 / (1 + F.exp(-score)) >= self.threshold, F.lit(False))


#: Weight, as a share of the votes, of the belief that labelers are right 19 times of 20 and three candidates of ten are personal.
BELIEF = 0.1


def _reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over the vote patterns of one kind.

    Per class (other, personal) and labeler the chance of a yes, given a vote; the
    posterior of each pattern; the share of personal data. Abstaining says nothing.
    The first posterior is the majority of the votes. A labeler whose yes would speak
    for the other class gets one chance for both classes: it loses its say.
    """
    total = votes.sum(axis=1)
    post = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.3))
    voted, yes = (votes != 0) * counts[:, None], (votes == 1) * counts[:, None]
    mass = BELIEF * voted.sum(axis=0) + 1
    for _ in range(rounds):
        sides = ((1 - post)[:, None], post[:, None])
        ups = [(yes * w).sum(axis=0) + mass * right for w, right in zip(sides, (0.05, 0.95))]
        alls = [(voted * w).sum(axis=0) + mass for w in sides]
        chances = np.array([u / a for u, a in zip(ups, alls)])
        pooled = (ups[0] + ups[1]) / (alls[0] + alls[1])
        chances = np.where(chances[1] >= chances[0], chances, pooled)
        share = float(((post * counts).sum() + BELIEF * counts.sum() * 0.3 + 0.3) / ((1 + BELIEF) * counts.sum() + 1))
        post = _posterior(votes, chances, share)
    return chances, post, share


def _posterior(votes: np.ndarray, chances: np.ndarray, share: float) -> np.ndarray:
    for_yes, for_no = np.log(chances[1] / chances[0]), np.log((1 - chances[1]) / (1 - chances[0]))
    odds = np.log(share / (1 - share)) + np.where(votes == 1, for_yes, np.where(votes == -1, for_no, 0.0)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _logistic(x: np.ndarray, target: np.ndarray, share: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a small penalty; features whose weight has the wrong sign are left out."""
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        z = np.concatenate((x[:, use], np.ones((len(x), 1))), axis=1)
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (share * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(len(w))
            w = w - np.clip(np.linalg.solve(hessian, z.T @ (share * (p - target)) + 1e-4 * w), -2, 2)
        full = np.zeros(x.shape[1])
        full[use] = w[:-1]
        wrong = full * signs < 0
        if not wrong.any():
            return full, float(w[-1])
        use &= ~wrong


def _fit_form(votes: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> FormModel:
    """The model of one kind from its vote patterns and how often each occurs.

    Votes that occur in no candidate enter the training with the posterior that the
    belief gives them, in single votes of a tenth of the whole weight, so that the classifier
    knows what to make of them.
    """
    chances, post, share = _reliabilities(votes, counts)
    n = votes.shape[1]
    single = np.concatenate((np.eye(n, dtype=int), -np.eye(n, dtype=int), np.zeros((1, n), dtype=int)))
    usual = np.repeat((shapes * counts[:, None]).sum(axis=0, keepdims=True) / counts.sum(), len(single), axis=0)
    every, target = np.concatenate((votes, single)), np.concatenate((post, _posterior(single, chances, share)))
    x = np.concatenate(((every == 1), (every == -1), np.concatenate((shapes, usual))), axis=1).astype(float)
    weight = np.concatenate((counts / counts.sum(), np.full(len(single), BELIEF / len(single))))
    w, b = _logistic(x, target, weight, np.repeat([1, -1, 0], (n, n, shapes.shape[1])))
    keys = [f"{v}+" for v in LABELERS] + [f"{v}-" for v in LABELERS] + list(SHAPES)
    return FormModel({v: (float(chances[1, i]), float(chances[0, i])) for i, v in enumerate(LABELERS)}, dict(zip(keys, map(float, w))), b)


def fit_spans(texts: DataFrame, text: str = "text", threshold: float = 0.5) -> SpanModel:
    """The model of all candidates of all texts."""
    names = ["form", *LABELERS, *SHAPES]
    found = texts.select(F.inline(candidates(F.coalesce(F.col(text), F.lit("")))))
    rows = bounded_rows(found.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names), PATTERNS, "vote patterns")
    forms = {}
    for form in FORMS:
        mine = [r for r in rows if r["form"] == form]
        if mine:
            forms[form] = _fit_form(np.array([[r[v] for v in LABELERS] for r in mine]), np.array([[r[s] for s in SHAPES] for r in mine], dtype=float),
                                    np.array([r["n"] for r in mine], dtype=float))
    return SpanModel(forms, threshold)


def _all_spans(base: Column, loose: Column, model: SpanModel) -> Column:
    extra = F.filter(loose, lambda c: model.accepts(c) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.concat(base, F.transform(extra, lambda c: F.struct(F.lit("model").alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))


def find_personal(docs: DataFrame, model: SpanModel, text: str = "text", spans: str = "spans") -> DataFrame:
    """`docs` with the array `spans` of (kind, start, end): base spans by kind and start, then those of the model."""
    base, loose = free_name(docs, "base_spans"), free_name(docs, "loose_spans")
    body = F.coalesce(F.col(text), F.lit(""))
    staged = docs.select(*docs.columns, base_spans(body).alias(base), candidates(body).alias(loose))
    return staged.select(*docs.columns, _all_spans(F.col(base), F.col(loose), model).alias(spans))


def personal_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *map(count, KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the place."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_e"), s["kind"].alias("kind"))))

    def piece(at: Column, upto: Column) -> Column:
        return F.substring(text, (at + 1).cast("int"), (upto - at).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        named = F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], -s["_e"]).alias("at"), F.when(s["start"] >= acc["at"], named).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("bigint"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_personal(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """`docs` with personal data replaced in `text`, and `chars`, if there is one, counted anew where that changed it."""
    model = fit_spans(docs.select(text), text)
    spans, fresh = free_name(docs, "spans"), free_name(docs, "fresh_text")
    found = find_personal(docs, model, text, spans)
    found = found.select("*", redacted(F.col(text), F.col(spans)).alias(fresh))
    count = F.when(F.size(spans) > 0, F.length(fresh)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType) if chars in docs.columns else None
    return found.select(*[F.col(fresh).alias(c) if c == text else count.alias(c) if c == chars else F.col(c) for c in docs.columns])
