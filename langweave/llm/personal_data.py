"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier learns from their consensus.

Candidates are the matches of four formats (e-mail, IP address, payment card, phone), matching or failing their
checks, and of looser forms of the same kinds. Each candidate gets votes for, against or none from five labelers: the
well-formed pattern, the checksum or range, a gazetteer, the words around it, and the characters beside it. The votes
of the whole corpus are counted by pattern (a bounded table: kinds x 3^5 votes x shapes). Expectation-maximisation
on these counts estimates, for each kind, how reliable each labeler is and how likely each pattern is personal data; a
logistic span classifier is then trained on the patterns under these soft labels. Matches that pass their format's checks always
count; the classifier adds others.

All work on texts is native expressions inside the row. Only pattern counts shuffle and only they reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from langweave.llm.columns import bound, unclashed, whole
from langweave.scratch import computed_once

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "edge")
MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"
SPAN = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string,base:boolean>>"
# Matches folded at a time.
FOLD_BLOCK = 128

# Formats. Possessive runs and look-behinds keep the search linear in long runs of one character class; they match
# what the plain forms match: a run that fails from its first character fails from all of them, and after a match the
# search goes on at its end (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Looser forms, for what a format misses: spelled-out addresses, and numbers run together with their neighbours.
LOOSE_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}+){1,8}+"
LOOSE_CARD = r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
LOOSE_PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) |[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"

IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
WELL_FORMED = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9 .-]{5,12}$",
}
# Gazetteers: ends of host names, first digits of card issuers, country calling codes, reserved address blocks.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|eu|ma|ch|at|be|nl|pt|ca|mx|ar|br|in|jp)$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)",
    "phone": r"^(?:\+(?:1|20|212|213|216|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[^0-9]?|\(|[2-9])",
}
CUES = {
    "email": r"e-?mail|contact|courriel|correo|write to|kontakt|address",
    "ip": r"\bip\b|server|host|login|address|from",
    "card": r"card|visa|master|amex|credit|debit|carte|tarjeta|karte|payment",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp|t[eé]l[eé]|anruf|contact",
}
COUNTER_CUES = r"version|release|isbn|issn|order|invoice|serial|section|chapter|ref\b|doi"
CONTEXT_CHARS = 40

EM_ROUNDS = 40
# Prior belief on each labeler: the chance of a vote (-1, 0, 1) on personal data, and on anything else. It weighs as much
# as PRIOR_COUNT candidates of each class, whatever the input: it gives the classes their meaning where candidates are few,
# and the votes prevail as candidates grow.
PRIOR = {
    "pattern": ((0.19, 0.01, 0.8), (0.59, 0.01, 0.4)),
    "check": ((0.01, 0.01, 0.98), (0.89, 0.01, 0.1)),
    "gazetteer": ((0.19, 0.01, 0.8), (0.49, 0.01, 0.5)),
    "context": ((0.05, 0.65, 0.3), (0.2, 0.7, 0.1)),
    "edge": ((0.05, 0.94, 0.01), (0.3, 0.69, 0.01)),
}
PRIOR_COUNT = 200
FIT_ROUNDS = 400
ACCEPT = 0.5
MASKS = {kind: f"<{kind.upper()}>" for kind in KINDS}


def located(text: Column, pattern: str) -> Column:
    """``start, end, value, before, after`` of all matches, in code points, with some characters on either side.

    The pieces between the matches give the places. Matches are folded in blocks, each from its own start, so that
    the work stays about linear in their number.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    nothing = F.array().cast(f"array<{MATCH}>")

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        before = F.right(pair["piece"], F.lit(CONTEXT_CHARS))
        after = F.left(pair["next"], F.lit(CONTEXT_CHARS))
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def fold(pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step)

    def placed(blocks: Column) -> Column:
        begin = F.aggregate(
            blocks, F.array(F.lit(0)), lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + b["at"]))
        )

        def shifted(block: Column, at: Column) -> Column:
            return F.transform(
                block["spans"],
                lambda s: F.struct(
                    (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), *[s[f].alias(f) for f in ("value", "before", "after")]
                ),
            )

        return F.flatten(F.zip_with(blocks, F.slice(begin, F.lit(1), F.size(blocks)), shifted))

    def blocked(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(FOLD_BLOCK))
        return bound(F.transform(starts, lambda k: fold(F.slice(pairs, k, F.lit(FOLD_BLOCK)))), placed)

    def paired(pieces: Column, values: Column) -> Column:
        return F.arrays_zip(
            F.slice(pieces, F.lit(1), F.size(values)).alias("piece"),
            values.alias("value"),
            F.slice(pieces, F.lit(2), F.size(values)).alias("next"),
        )

    def spans(values: Column) -> Column:
        pairs = bound(F.split(text, pattern, -1), lambda pieces: paired(pieces, values))
        return F.when(F.size(values) > 0, bound(pairs, blocked)).otherwise(nothing)

    return bound(values, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The check of a format's match."""
    digits = _digits(value)
    if kind == "email":
        return value.contains("@")
    if kind == "ip":
        return value.rlike(IP_VALID)
    if kind == "card":
        # Luhn is asked only of lengths that fit.
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def candidates(text: Column) -> Column:
    """All candidate spans; ``base`` marks matches of a format that pass its check."""
    no_spans = F.array().cast(SPAN)

    def family(kind: str, pattern: str, guard: Column, strict: bool) -> Column:
        def shaped(span: Column) -> Column:
            base = passes(kind, span["value"]) if strict else F.lit(False)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                *[span[f].alias(f) for f in ("start", "end", "value", "before", "after")],
                base.alias("base"),
            )

        return F.when(guard, F.transform(located(text, pattern), shaped).cast(SPAN)).otherwise(no_spans)

    digits = text.rlike("[0-9]")
    return F.concat(
        family("email", EMAIL, text.contains("@"), True),
        family("ip", IP, digits & text.rlike(r"[0-9]\.[0-9]"), True),
        family("card", CARD, digits & text.rlike(CARD), True),
        family("phone", PHONE, text.contains("+"), True),
        family("email", LOOSE_EMAIL, text.rlike(r"(?i)[\[(] ?at ?[\])]"), False),
        family("card", LOOSE_CARD, digits & text.rlike(r"[0-9]{4}[ -]?[0-9]{4}"), False),
        family("phone", LOOSE_PHONE, digits & text.rlike(r"[0-9]{3}[.-][0-9]{4}"), False),
    )


def _by_kind(kind: Column, choose) -> Column:
    value = F.lit(None)
    for k, name in reversed(list(enumerate(KINDS))):
        value = F.when(kind == k, choose(name)).otherwise(value)
    return value


def voted(span: Column) -> Column:
    """The span with its votes (1 for, -1 against, 0 none) and a coarse ``shape``."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))

    value, kind = span["value"], span["kind"]
    formed = _by_kind(kind, lambda k: value.rlike(WELL_FORMED[k]))
    valid = _by_kind(kind, lambda k: value.rlike(r"[.)\]] ?[A-Za-z]{2,}$") if k == "email" else passes(k, value))
    listed = _by_kind(kind, lambda k: value.rlike(GAZETTEER[k]))
    around = F.lower(F.concat(span["before"], F.lit(" "), span["after"]))
    cued = _by_kind(kind, lambda k: around.rlike(CUES[k]))
    glued = span["before"].rlike(r"[\p{L}0-9_/@=]$") | span["after"].rlike(r"^[\p{L}0-9_/@=]")
    votes = {
        "pattern": vote(formed, ~formed),
        "check": vote(valid, ~valid),
        "gazetteer": vote(listed, ~listed),
        "context": vote(cued & ~around.rlike(COUNTER_CUES), ~cued & around.rlike(COUNTER_CUES)),
        "edge": vote(F.lit(False), glued),
    }
    shape = F.least(F.floor(F.length(value) / 6), F.lit(5)).cast("int")
    return F.struct(
        *[span[f].alias(f) for f in ("kind", "start", "end", "base")],
        *[votes[name].alias(name) for name in LABELERS],
        shape.alias("shape"),
    )


def vote_counts(docs: DataFrame) -> DataFrame:
    """Candidates by kind, votes and shape, over the ``_found`` column: 4 x 3^5 x 6 rows at most."""
    spans = docs.select(F.inline("_found"))
    return spans.groupBy("kind", *LABELERS, "shape").agg(F.count(F.lit(1)).alias("n"))


def consensus(patterns: Iterable[Row]) -> list[float]:
    """Expectation-maximisation over vote patterns: the probability of each that its candidates are personal data.

    A labeler has, per kind and class, a distribution over its three votes; votes are independent given the class. Each
    kind starts from ``PRIOR`` and is smoothed by ``PRIOR_COUNT`` candidates of each class that vote like it.
    """
    patterns = list(patterns)
    posterior = [0.0] * len(patterns)
    for kind in {row["kind"] for row in patterns}:
        places = [k for k, row in enumerate(patterns) if row["kind"] == kind]
        for k, p in zip(places, _consensus_of_kind([patterns[k] for k in places])):
            posterior[k] = p
    return posterior


def _consensus_of_kind(patterns: list[Row]) -> list[float]:
    total = sum(row["n"] for row in patterns)
    belief = {(name, v - 1): (PRIOR[name][0][v], PRIOR[name][1][v]) for name in LABELERS for v in range(3)}
    table, share = dict(belief), 0.5
    posterior: list[float] = []
    for _ in range(EM_ROUNDS):
        posterior = []
        for row in patterns:
            odds = math.log(share / (1 - share))
            for name in LABELERS:
                yes, no = table[name, row[name]]
                odds += math.log(yes / no)
            posterior.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
        positive = sum(row["n"] * p for row, p in zip(patterns, posterior))
        share = (positive + PRIOR_COUNT) / (total + 2 * PRIOR_COUNT)
        for name in LABELERS:
            for vote in (-1, 0, 1):
                yes = sum(row["n"] * p for row, p in zip(patterns, posterior) if row[name] == vote)
                no = sum(row["n"] * (1 - p) for row, p in zip(patterns, posterior) if row[name] == vote)
                table[name, vote] = (
                    (yes + PRIOR_COUNT * belief[name, vote][0]) / (positive + PRIOR_COUNT),
                    (no + PRIOR_COUNT * belief[name, vote][1]) / (total - positive + PRIOR_COUNT),
                )
    return posterior


def features(row: Row) -> list[str]:
    own = f"kind{row['kind']}"
    return ["bias", *[f"{name}{row[name]}" for name in LABELERS], own, f"{own}check{row['check']}", f"shape{row['shape']}"]


def fit_classifier(patterns: Iterable[Row]) -> dict[str, float]:
    """Weights of a logistic model of ``features``, fitted to the consensus by gradient descent on all patterns.

    A pattern counts by the logarithm of its candidates, so that a frequent form doesn't hide the rare ones.
    """
    patterns = sorted(patterns, key=lambda row: tuple(row))
    labels = consensus(patterns)
    mass = [math.log1p(row["n"]) for row in patterns]
    names = [features(row) for row in patterns]
    weights = {name: 0.0 for found in names for name in found}
    for _ in range(FIT_ROUNDS if patterns else 0):
        slope = {name: 0.002 * w for name, w in weights.items()}
        for found, label, m in zip(names, labels, mass):
            score = sum(weights[name] for name in found)
            error = m / sum(mass) * (1 / (1 + math.exp(-max(-40.0, min(40.0, score)))) - label)
            for name in found:
                slope[name] += error
        weights = {name: w - 1.0 * slope[name] for name, w in weights.items()}
    return {name: round(w, 6) for name, w in weights.items()}


def _score(span: Column, weights: dict[str, float]) -> Column:
    """The classifier's log-odds; features it never saw weigh nothing."""
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    names = [F.lit("bias"), *[F.concat(F.lit(name), span[name].cast("string")) for name in LABELERS]]
    own = F.concat(F.lit("kind"), span["kind"].cast("string"))
    names += [own, F.concat(own, F.lit("check"), span["check"].cast("string"))]
    names += [F.concat(F.lit("shape"), span["shape"].cast("string"))]
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(F.try_element_at(table, name), F.lit(0.0))
    return total


def _decided(found: Column, weights: dict[str, float]) -> Column:
    """Base spans, and accepted others that overlap no base span and no earlier accepted one."""

    def apart(span: Column, others: Column) -> Column:
        return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))

    def keep(base: Column) -> Column:
        threshold = math.log(ACCEPT / (1 - ACCEPT))
        extra = F.filter(found, lambda s: ~s["base"] & apart(s, base))
        scored = F.transform(
            extra, lambda s: F.struct((-_score(s, weights)).alias("cost"), s["start"], s["end"], s["kind"], s.alias("span"))
        )
        # The surest first: a span inside one that counts is not added.
        ordered = F.array_sort(F.filter(scored, lambda o: o["cost"] <= -threshold))
        spans = F.transform(ordered, lambda o: o["span"])
        chosen = F.aggregate(
            spans, F.slice(base, 1, 0), lambda done, s: F.when(apart(s, done), F.concat(done, F.array(s))).otherwise(done)
        )
        return F.concat(base, chosen)

    return bound(F.filter(found, lambda s: s["base"]), keep)


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an array of ``kind, start, end, base``, by kind as in ``KINDS``, then start; code
    points, the end exclusive.

    A null or empty text has no spans. Repeated rows get equal spans, and each counts as evidence. Without candidates
    nothing is learned and nothing added. Empty tables give an empty result. A column ``spans`` is replaced.
    """
    docs = unclashed(docs, "spans", "_found")
    content = whole(text)
    votes = bound(candidates(content), lambda c: F.transform(c, voted))
    found = computed_once(docs, "_found", votes)
    weights = fit_classifier(vote_counts(computed_once(docs.select(text), "_found", votes)).collect())
    spans = F.transform(
        F.array_sort(
            F.transform(
                _decided(F.col("_found"), weights),
                lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")),
            )
        ),
        lambda s: F.struct(
            F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["base"].alias("base"),
        ),
    )
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")
    return found.withColumn("spans", F.when(F.size("_found") > 0, spans).otherwise(nothing)).drop("_found")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(text: str, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask of its kind."""
    content = F.col(text)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    masks = F.create_map(*[F.lit(x) for item in MASKS.items() for x in item])

    def step(done: Column, s: Column) -> Column:
        plain = F.substring(content, done["at"] + 1, s["start"] - done["at"])
        added = F.when(s["start"] >= done["at"], F.concat(plain, masks[s["kind"]])).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], added).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(
        ordered, first, step, lambda d: F.concat(d["out"], F.substring(content, d["at"] + 1, F.length(content)))
    )
    return F.when(F.size(spans) > 0, rest).otherwise(content)
