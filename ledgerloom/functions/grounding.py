"""Whether an answer says only what its evidence holds: figures, ids, codes, causes, uniqueness, and kinds of claims by sentence.

Evidence is whatever the tools returned, as JSON of any shape: it is parsed as a variant and written again, so that escapes become
the characters they stand for, and read as one vocabulary of figures, ids and codes. What a tool returned as an error is
no evidence, though it repeats the id that was asked for. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import ACCURACY, DISTRIBUTION, FORWARD, ID, bound, low_claims, low_has_any, sentences

#: Figures and codes of an answer (fixed values), and capitals that are no code.
NUMBER, CODE, NO_CODE = r"\d[\d,]*(?:\.\d+)?", r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", ("UTR", "IST", "CSV")
#: Phrases that guess, that assert a cause, that speak of one, that claim uniqueness, and that decline (fixed values).
SPECULATION = (
    "probably", "presumably", "i assume", "i'd guess", "i would guess", "must have been", "it seems that", "appears to have been", "my guess",
    "typically this", "usually this", "in most cases this",
)
ASSERTED = (
    "caused by", "the cause is", "the cause was", "due to the refund", "due to the chargeback", "due to the payment", "because of the refund",
    "because of the chargeback", "because of the payment", "responsible for", "this proves", "confirms that", "proves that",
)
#: Of these, the ones that repeat a link the evidence itself declares (fixed values).
DECLARED = ("caused by", "the cause is", "the cause was")
CAUSAL = ("because", "due to", "caused by", "the reason", "as a result of")
UNIQUE = ("the only", "the sole", "no other", "none other", "is unique", "only one", "the single", "no others")
DECLINES = (
    "could not determine", "cannot determine", "can't determine", "no tool", "not able to", "unable to", "does not measure", "cannot say", "no way to",
    "does not track", "not measured", "cannot answer", "not exposed", "does not record", "no data", "not something i can",
)
#: What each tool's results can bear out (fixed values); no tool has distributions over time, rates of accuracy or forecasts.
CAPABILITIES = {
    "why_not": ("reasons", "entity_ids", "entity_dates"), "get_entity": ("entity_ids", "entity_dates", "money_totals"),
    "list_exceptions": ("counts", "money_totals", "entity_ids", "population_counts"), "settlement_breakdown": ("settlement_arithmetic", "money_totals"),
    "explain_finding": ("settlement_arithmetic", "money_totals", "entity_ids", "reasons"), "queue_breakdown": ("money_totals", "counts", "population_counts"),
    "aggregate_declines": ("counts", "reasons", "population_counts"), "trace_chain": ("chain_hops", "entity_ids", "entity_dates"),
    "what_would_change": ("counterfactual", "reasons"), "compare_findings": ("money_totals", "counts", "entity_ids", "population_counts"),
    "run_summary": ("money_totals", "counts"), "search_entities": ("entity_ids", "counts", "reasons", "entity_dates", "population_counts"),
}
#: The kinds of claims, in the order they are looked for, and what evidence each needs (fixed values).
NEEDS = {"timing": "temporal_distribution", "accuracy": "accuracy_rates", "future": "prediction"}
VERDICT = "ok boolean, numbers_verified array<string>, numbers_unverified array<string>, ids_unverified array<string>, codes_unverified array<string>, speculative array<string>, uncaused boolean, contradicted boolean, claims array<string>, checked int"


def digits(token: Column) -> Column:
    """A figure without its commas, and without zeros behind a point."""
    plain = F.replace(token, F.lit(","), F.lit(""))
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)


def evidence_text(results: Column) -> Column:
    """The results (texts of JSON) that aren't errors, in one text; what is no JSON counts as it stands, and null as nothing."""
    some = F.filter(results, lambda r: r.isNotNull() & ~F.coalesce(F.array_contains(F.json_object_keys(r), "error"), F.lit(False)))
    return F.array_join(F.transform(some, lambda r: F.coalesce(F.to_json(F.try_parse_json(r)), r)), "\n")


def said(prose: Column, phrases: tuple[str, ...]) -> Column:
    """Those of ``phrases`` that a prose holds, whatever its case."""
    return bound(F.lower(prose), lambda low: low_said(low, phrases))


def low_said(low: Column, phrases: tuple[str, ...]) -> Column:
    """``said`` of a prose in lower case; most hold none, which is cheaper to see at once."""
    held = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    return F.when(low_has_any(low, phrases), held).otherwise(F.array().cast("array<string>"))


#: A prose without any of these makes no claim in any sentence.
HINTS = (*DISTRIBUTION, *ACCURACY, *FORWARD, "will")


def claim_kinds(prose: Column, able: Column | None = None, low: Column | None = None) -> Column:
    """Kinds of claims, by sentence, that ``able`` (what the evidence can bear out) doesn't cover; each sentence counts for its first kind,
    and one that declines makes no claim. ``low``: the prose in lower case, if it is there."""
    low = F.lower(prose) if low is None else low
    able = F.array().cast("array<string>") if able is None else able

    def kind(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, test in reversed(low_claims(low).items()):
            out = F.when(test & ~F.array_contains(able, NEEDS[name]), name).otherwise(out)
        return F.when(~low_has_any(low, DECLINES), out)

    kinds = F.transform(sentences(prose), lambda s: bound(F.lower(s), kind))
    found = F.array_sort(F.array_distinct(F.filter(kinds, lambda k: k.isNotNull())))
    return F.when(bound(low, lambda l: low_has_any(l, HINTS)), found).otherwise(F.array().cast("array<string>"))


def capabilities(tools: Column) -> Column:
    """What the tools called can bear out together; an unknown tool nothing."""
    table = F.create_map(*[x for k, v in CAPABILITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(F.coalesce(tools, none), lambda t: F.coalesce(F.try_element_at(table, t), none))))


def grounded(answer: Column, tools: Column, results: Column) -> Column:
    """``VERDICT`` of an answer (null: empty) from the tools called and what they returned, both arrays of texts (null: none).

    Figures of one digit aren't checked. A cause that the evidence declares itself (``caused_by``) may be repeated.
    Uniqueness is contradicted by a ``total_with_this_code`` of two or more. ``checked`` counts figures and ids.
    """
    none = F.array().cast("array<string>")
    answer, results = F.coalesce(answer, F.lit("")), F.coalesce(results, none)
    whole = lambda a: F.struct(a.alias("answer"), F.lower(a).alias("low"), evidence_text(results).alias("hay"), capabilities(tools).alias("able"), (F.size(F.coalesce(tools, none)) == 0).alias("untold"))
    return bound(answer, lambda a: bound(whole(a), lambda x: bound(_tokens(x), lambda t: bound(_findings(x, t), lambda f: _verdict(f)))))


def _every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _tokens(x: Column) -> Column:
    """Figures that the evidence knows; figures and ids of the answer."""
    numbers = F.filter(_every(x["answer"], NUMBER), lambda t: F.length(F.replace(digits(t), F.lit("."), F.lit(""))) > 1)
    return F.struct(F.transform(_every(x["hay"], NUMBER), digits).alias("known"), numbers.alias("numbers"), _every(x["answer"], ID).alias("ids"))


def _findings(x: Column, t: Column) -> Column:
    """The verdict's fields but for ``ok``."""
    answer, low, hay = x["answer"], x["low"], x["hay"]
    is_known = lambda n: F.array_contains(t["known"], digits(n))
    new = lambda found, pattern: F.array_sort(F.array_except(F.array_distinct(found), _every(hay, pattern)))
    codes = F.array_except(new(_every(answer, CODE), CODE), F.array(*map(F.lit, NO_CODE)))
    declared = hay.rlike(r'"caused_by":\s*"[^"]')
    asserted = low_said(low, ASSERTED)
    asserted = F.when(declared, F.array_except(asserted, F.array(*map(F.lit, DECLARED)))).otherwise(asserted)
    guesses = F.array_sort(F.array_distinct(F.concat(low_said(low, SPECULATION), asserted)))
    uncaused = x["untold"] & low_has_any(low, CAUSAL)
    totals = F.regexp_extract_all(hay, F.lit(r'"total_with_this_code":\s*(\d+)'), F.lit(1))
    contradicted = low_has_any(low, UNIQUE) & F.exists(totals, lambda n: F.try_to_number(n, F.lit("9" * 18)) > 1)
    return F.struct(
        F.filter(t["numbers"], is_known).alias("right"), F.filter(t["numbers"], lambda n: ~is_known(n)).alias("wrong"), new(t["ids"], ID).alias("ids"), codes.alias("codes"), guesses.alias("guesses"),
        uncaused.alias("uncaused"), contradicted.alias("contradicted"), claim_kinds(answer, x["able"], low).alias("claimed"), (F.size(t["numbers"]) + F.size(t["ids"])).alias("checked"),
    )


def _verdict(f: Column) -> Column:
    ok = ~f["uncaused"] & ~f["contradicted"]
    for c in ("wrong", "ids", "codes", "guesses", "claimed"):
        ok = ok & (F.size(f[c]) == 0)
    return F.struct(
        ok.alias("ok"), f["right"].alias("numbers_verified"), f["wrong"].alias("numbers_unverified"), f["ids"].alias("ids_unverified"), f["codes"].alias("codes_unverified"), f["guesses"].alias("speculative"),
        f["uncaused"].alias("uncaused"), f["contradicted"].alias("contradicted"), f["claimed"].alias("claims"), f["checked"].alias("checked"),
    )
