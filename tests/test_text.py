import pytest
from pyspark.sql import functions as F

from modalith.functions import text as tx

#: The words and phrases of the written rules, with what each says.
CUES = {"must": "mandatory", "shall": "mandatory", "required to": "mandatory", "should": "recommended", "recommended": "recommended", "may": "optional", "optional": "optional", "could": "optional", "can": "optional"}
WISHES = ("would be nice if", "would be useful if", "low-priority enhancement", "future enhancement", "nice-to-have", "wishlist")
FRAMES = [f"it {v} be {a} {t}" for v in ("would", "will", "could", "might") for a in ("useful", "nice", "desirable", "beneficial", "helpful") for t in ("if", "for", "to")]
STATES = [f"it is {a} {t}" for a in ("desirable", "useful", "nice", "beneficial", "helpful") for t in ("if", "for", "that", "to")]


def cases():
    """Texts made of the rules, each with its reading."""
    for cue, label in CUES.items():
        yield f"Printers {cue} label parcels", label, "explicit_modal"
        yield f"Printers {cue.upper()} label parcels", label, "explicit_modal"
    for cue in ("must", "shall", "should", "may", "could", "can"):
        yield f"Printers {cue} not label parcels", "negated", "negated_modal"
        yield f"Never {cue} printers label parcels", "negated", "negated_modal"
        yield f"Printers {cue} not label parcels, yet scanners must read them", "mandatory", "explicit_modal"
    for short in ("can't", "couldn't", "shouldn't", "mustn't", "cannot"):
        yield f"Printers {short} label parcels", "negated", "negated_modal"
    for wish in WISHES:
        yield f"Parcel labels: {wish} printers make them", "nice_to_have", "weak_phrase"
    for frame in FRAMES + STATES:
        yield f"{frame} printers label parcels", "nice_to_have", "weak_phrase"
        yield f"{frame} printers label parcels, and scanners must read them", "mandatory", "explicit_modal"
    yield "It would be nice if printers could label parcels", "nice_to_have", "weak_phrase"
    yield "Labelled parcels would be useful.", "nice_to_have", "weak_phrase"
    yield "Labelled parcels are what printers may make, which is useful.", "optional", "explicit_modal"
    yield "The system labels parcels", "mandatory", "heuristic_system_verb"
    yield "system labels parcels", "mandatory", "heuristic_system_verb"
    yield "Parcels are labelled", "unknown", "unknown"
    # the strongest of several categories wins
    order = ("must", "should", "may")
    for i, strong in enumerate(order):
        for weak in order[i + 1 :]:
            yield f"Printers {weak} label parcels and scanners {strong} read them", CUES[strong], "explicit_modal"


CASES = sorted(set(cases()))


def test_text_modality(spark):
    df = tx.with_text_modality(spark.createDataFrame(CASES, "text string, modality string, basis string"), "text")
    for r in df.collect():
        assert (r.t.modality, r.t.basis) == (r.modality, r.basis), r.text


@pytest.mark.parametrize("text,multi", [("Printers may label parcels and scanners must read them", True), ("Printers must label parcels and scanners shall read them", False), ("It would be nice if printers must label parcels", True)])
def test_several_categories_are_flagged(spark, text, multi):
    assert tx.with_text_modality(spark.createDataFrame([(text,)], "x string"), "x").first().t.multi_modal is multi


@pytest.mark.parametrize("text,ordinal,strict,kind", [("Printers shall label parcels", 1, True, "modal_escalation"), ("Printers could label parcels", 0, True, "frame_only"), ("It is helpful if printers label parcels", 0, False, ""), ("The system labels parcels", 0, False, "")])
def test_drift_tells_the_obligation_from_the_frame(spark, text, ordinal, strict, kind):
    df = tx.with_text_modality(spark.createDataFrame([(text, ordinal)], "text string, o int"), "text")
    r = df.withColumns(tx.drift(F.col("t"), F.col("o"))).first()
    assert (r.strict_text_overcommit, r.strict_kind) == (strict, kind)


@pytest.mark.parametrize("subject", ["Printers", "The depot", "Each scanner of the depot"])
@pytest.mark.parametrize("modal", ["shall", "must", "should be able to", "may"])
@pytest.mark.parametrize("quote", ["", "'", '"'])
def test_capability_is_what_follows_the_modal(spark, subject, modal, quote):
    text = f"{quote}{subject} {modal} label parcels of 2.5 kg every 60 seconds.{quote}"
    assert spark.range(1).select(tx.capability_text(F.lit(text)).alias("c")).first().c == "label parcels of 2.5 kg every 60 seconds"


def test_cells(spark):
    df = spark.createDataFrame([("29.8%", "TRUE "), ("0.5", "1"), ("x", "yes"), (None, None)], "a string, b string").select(tx.ratio(F.col("a")).alias("a"), tx.truthy(F.col("b")).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(0.298, True), (0.5, True), (None, False), (None, None)]
