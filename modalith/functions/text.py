"""Modal strength of requirement texts, capability clauses and candidate filters, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordinal strengths of the labels.
ORDINAL = {"mandatory": 3, "recommended": 2, "optional": 1, "nice_to_have": 0}
#: Words that carry modal force; `required` counts before `to` only.
CUES = {"must": "mandatory", "shall": "mandatory", "required": "mandatory", "should": "recommended", "recommended": "recommended", "may": "optional", "optional": "optional", "could": "optional", "can": "optional"}
#: Phrases of weak intent.
WEAK = (
    r"would be (nice|useful) if|it (would|will|could|might) be (useful|nice|desirable|beneficial|helpful) (if|for|to)( |$)"
    r"|it is (desirable|useful|nice|beneficial|helpful) (if|for|that|to)( |$)|low[ -]priority enhancement|future enhancement|nice[ -]to[ -]have|wishlist"
)
TRAILING_WEAK = r"(would be|is) useful[. ]*$"
SYSTEM_VERB = r"^(the )?system [a-z]+"
NEGATORS = ("not", "never")


def ordinal(label: Column) -> Column:
    return F.create_map(*[x for k, v in ORDINAL.items() for x in (F.lit(k), F.lit(v))])[label]


def source_statement(capability: Column, modality: Column, variant: Column) -> Column:
    """The templated statement of a condition; SHALL takes the place of MUST in the mandatory one only."""
    keyword = F.when(modality == "mandatory", F.when(variant == "shall", "SHALL").otherwise("MUST")).when(modality == "recommended", "SHOULD").when(modality == "optional", "MAY")
    opening = F.when(modality == "nice_to_have", F.lit("It would be useful if the system could ")).otherwise(F.concat(F.lit("The system "), keyword, F.lit(" ")))
    return F.concat(opening, capability, F.lit("."))


def tokens(text: Column) -> Column:
    """Lower-case words; contractions of not are spelled out."""
    x = F.regexp_replace(F.lower(text), r"(^|[^a-z])(cannot|can['’]t)([^a-z]|$)", "$1can not$3")
    x = F.regexp_replace(x, r"(^|[^a-z])shan['’]t([^a-z]|$)", "$1shall not$2")
    x = F.regexp_replace(x, r"n['’]t", " not ")
    return F.filter(F.split(x, "[^a-z]+"), lambda w: w != "")


def shape(text: Column) -> Column:
    """The text with every digit made a zero: with_text_modality() gives both the same, since digits only part words."""
    return F.translate(text, "123456789", "000000000")


def _marked(w: Column) -> Column:
    label = F.create_map(*[F.lit(x) for kv in CUES.items() for x in kv])
    marked = F.transform(
        w,
        lambda word, i: F.struct(
            word.alias("word"),
            F.when((word == "required") & (F.coalesce(F.try_element_at(w, i + 2), F.lit("")) != "to"), F.lit(None)).otherwise(label[word]).alias("label"),
            (
                (F.coalesce(F.try_element_at(w, i + 2), F.lit("")) == "not") | F.exists(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda n: n.isin(*NEGATORS))
            ).alias("negated"),
        ),
    )
    return F.filter(marked, lambda c: c["label"].isNotNull())


def with_cues(rows: DataFrame, text: str, out: str = "cues") -> DataFrame:
    """rows with array<struct<word, label, negated>> of the modal cues in order.

    A cue is negated by `not` right after it, or by `not` or `never` among the three words before. The words are a
    column of their own, since a projection that is used several times is then computed once."""
    return rows.withColumn("_w", tokens(F.col(text))).withColumn(out, _marked(F.col("_w"))).drop("_w")


def with_text_modality(rows: DataFrame, text: str, out: str = "t") -> DataFrame:
    """rows with struct<modality, basis, multi_modal, modals_found, readable>.

    A positive cue beats a weak phrase and a negated cue; a weak phrase beats only `could`, the word of its own
    frame; a trailing weak phrase counts only without any cue."""
    low = F.lower(F.col(text))
    rows = with_cues(rows, text, "_c").withColumns({"_weak": low.rlike(WEAK), "_tail": low.rlike(TRAILING_WEAK), "_verb": low.rlike(SYSTEM_VERB)})
    found, weak = F.col("_c"), F.col("_weak")
    rows = rows.withColumns(
        {
            "_labels": F.transform(F.filter(found, lambda c: ~c["negated"] & ~(weak & (c["word"] == "could"))), lambda c: c["label"]),
            "_kinds": F.array_distinct(F.transform(F.filter(found, lambda c: ~(weak & (c["word"] == "could"))), lambda c: c["label"])),
            "_soft": weak | ((F.size(found) == 0) & F.col("_tail")),
        }
    )
    has = lambda k: F.array_contains("_labels", k)
    rows = rows.withColumn("_strong", F.when(has("mandatory"), "mandatory").when(has("recommended"), "recommended").when(has("optional"), "optional"))
    strong, soft, cued, verb = F.col("_strong"), F.col("_soft"), F.size("_c") > 0, F.col("_verb")
    rows = rows.withColumn("_m", F.when(strong.isNotNull(), strong).when(soft, "nice_to_have").when(cued, "negated").when(verb, "mandatory").otherwise("unknown"))
    basis = F.when(strong.isNotNull(), "explicit_modal").when(soft, "weak_phrase").when(cued, "negated_modal").when(verb, "heuristic_system_verb").otherwise("unknown")
    rows = rows.withColumns({"_b": basis, "_multi": F.size("_kinds") + F.when(weak, 1).otherwise(0) > 1, "_found": F.transform("_c", lambda c: c["word"])})
    t = F.struct(F.col("_m").alias("modality"), F.col("_b").alias("basis"), F.col("_multi").alias("multi_modal"), F.col("_found").alias("modals_found"), (~F.col("_m").isin("unknown", "negated")).alias("readable"))
    return rows.withColumn(out, t).drop("_c", "_weak", "_tail", "_verb", "_labels", "_kinds", "_soft", "_strong", "_m", "_b", "_multi", "_found")


def drift(t: Column, source_ordinal: Column) -> dict[str, Column]:
    """Strengthening and weakening of a text against its source: broad, strict, kind, undercommit. t: the struct of with_text_modality()."""
    gen = ordinal(t["modality"])
    over = F.coalesce(gen > source_ordinal, F.lit(False))
    strict = over & t["basis"].isin("explicit_modal", "weak_phrase")
    kind = F.when(strict, F.when(gen >= 2, "modal_escalation").otherwise("frame_only")).otherwise("")
    return {"text_overcommit": over, "strict_text_overcommit": strict, "strict_kind": kind, "text_undercommit": F.coalesce(gen < source_ordinal, F.lit(False)), "parse_status": F.when(t["readable"], "ok").otherwise("unparsed")}


def capability_text(requirement: Column) -> Column:
    """The bare capability: quotes, list mark, subject, modal, `be able to` and the final period removed."""
    x = F.trim(F.regexp_replace(requirement, r"^['\"]+|['\"]+$", ""))
    x = F.regexp_replace(x, r"^[-*] *", "")
    x = F.regexp_replace(x, r"^.*?(^|[^A-Za-z])(shall|must|should|may|will|can|could|SHALL|MUST|SHOULD|MAY|WILL|CAN|COULD) +", "")
    x = F.regexp_replace(x, r"^be able to +", "")
    return F.trim(F.regexp_replace(x, r"[.]+$", ""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def candidate_reasons(requirement: Column, capability: Column) -> Column:
    """Why a candidate is dropped, in a fixed order; empty if it is included."""
    low = F.lower(requirement)
    n = word_count(requirement)
    checks = (
        (n < 5, "too_short"),
        (n > 35, "too_long"),
        (low.rlike(r"[.!?] +[a-z]"), "multi_sentence"),
        (low.rlike(r"(^|[^a-z])(not|never|no|cannot)([^a-z]|$)|n't"), "negation"),
        (low.rlike(r"[=<>{}^]"), "formula_or_symbol"),
        (low.rlike(r" and .* and | or .* or | and .* or |;| then "), "possibly_multiple_capabilities"),
        (word_count(capability) < 2, "empty_or_too_short_capability"),
        (F.lower(capability).rlike(r"(^|[^a-z])(shall|must|should|may|will|can|could)([^a-z]|$)"), "residual_modal_in_capability"),
        (F.lower(capability).rlike(r" (of|to|for|with|by|in|on|at|from)$"), "stranded_preposition"),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def truthy(x: Column) -> Column:
    """Text of a table cell to a boolean: 1, 1.0 and true only."""
    return F.lower(F.trim(x)).isin("1", "1.0", "true")


def ratio(x: Column) -> Column:
    """29.8% to 0.298; other numbers as they are; else null."""
    text = F.trim(x)
    return F.when(text.endswith("%"), F.regexp_replace(text, "%$", "").try_cast("double") / 100).otherwise(text.try_cast("double"))
