"""Rules over report texts as column expressions; wordings are parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of score tiers; fixed values.
FMA_TIERS = (4, 10, 15, 19)
BI_TIERS = (20, 60, 90)
STAGE_TIERS = (3, 5)


def tier(score: Column, ends: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the first tier whose end is not under the score; the last name beyond all ends."""
    out = F.lit(names[-1])
    for end, name in reversed(list(zip(ends, names))):
        out = F.when(score <= end, name).otherwise(out)
    return F.when(score.isNull(), None).otherwise(out)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def first_of(text: Column, marks: Sequence[str]) -> Column:
    """Place, from 1, of the first of several marks; null if none occurs."""
    return F.array_min(F.array(*(F.nullif(F.instr(text, m), F.lit(0)) for m in marks)))


def replace_first(text: Column, pattern: str, by: str | Column) -> Column:
    """Replace only the first match."""
    at, hit = F.regexp_instr(text, F.lit(pattern)), F.regexp_substr(text, F.lit(pattern))
    by = F.lit(by) if isinstance(by, str) else by
    return F.when(hit.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(hit), F.length(text))))


def with_duration(text: Column, days: Column, lead: str = "course", unit: str = "days", ends: str = ",.") -> Column:
    """The trimmed text with its first statement of the course, from ``lead`` up to one of ``ends``, said anew from the
    data; a statement that no end follows stays. Empty for a null or blank text."""
    stops = re.escape(ends)
    said = F.concat(F.lit(f"{lead} "), days.cast("int").cast("string"), F.lit(f" {unit}"))
    return F.coalesce(replace_first(F.trim(text), rf"{re.escape(lead)}[^{stops}]*?(?=[{stops}])", said), F.lit(""))


def strip_thinking(text: Column, stops: Sequence[str] = ("<|im_end|>", "<|im_start|>", "</s>")) -> Column:
    """Without the first think block, cut at the first chat mark, trimmed."""
    bare = replace_first(text, r"(?s)<think>.*?</think>", "")
    at = first_of(bare, stops)
    return F.trim(F.when(at.isNull(), bare).otherwise(F.substring(bare, F.lit(1), at - 1)))


def values_agree(text: Column, pattern: str, expected: Column) -> Column:
    """struct(missing, wrong): whether no value, or some other value than expected, stands in the text.
    ``pattern`` has one group, the number."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    wrong = ~F.forall(found, lambda v: v.try_cast("double") == expected.cast("double"))
    return F.struct((F.size(found) == 0).alias("missing"), F.coalesce(wrong, F.lit(True)).alias("wrong"))


LEAKS = {
    "placeholder": r"\{[a-z_]+\}|\[[A-Z_]{3,}\]",
    "thinking": r"(?i)</?think>",
    "prompt_echo": r"(?i)<\|im_(start|end)\|>|^\s*(system|user|assistant)\s*:",
    "metric": r"(?i)\b(fma|bi|barthel)[^.;]{0,12}\d",
}

WRIST_SCORE = r"(?i)\bwrist\s*\d+\s*points?\b"
#: Words of instructions, and wordings of the prompt's own list of what must not be said.
INSTRUCTIONS = ("avoid", "do not", "never", "must not", "should not")
ECHOES = ("not provided in the input", "and similar statements", "unsupported statements")


def leak_flags(text: Column, own_id: Column | None = None, id_pattern: str = r"\b[SP]\d{2,}\b", patterns: Mapping[str, str] = LEAKS) -> dict[str, Column]:
    """One boolean for each rule; ``other_patient`` if an id that is not ``own_id`` stands in the text."""
    out = {name: text.rlike(p) for name, p in patterns.items()}
    if own_id is not None:
        out["other_patient"] = F.exists(F.regexp_extract_all(text, F.lit(id_pattern), F.lit(0)), lambda x: x != own_id)
    return out


def constraint_echo(text: Column, instructions: Sequence[str] = INSTRUCTIONS, echoes: Sequence[str] = ECHOES) -> Column:
    """Whether a text copies its safety instructions: an instruction together with a wording of the prompt.
    Either of them alone is no fault."""
    return contains_any(F.lower(text), [w.lower() for w in instructions]) & contains_any(F.lower(text), [w.lower() for w in echoes])


def recommendation_audit(text: Column, forbidden: Column, id_pattern: str = r"\b[SP]\d{2,}\b", patterns: Mapping[str, str] = LEAKS, wrist: str = WRIST_SCORE, instructions: Sequence[str] = INSTRUCTIONS, echoes: Sequence[str] = ECHOES) -> Column:
    """struct of the audit of a recommendation, which names no patient and no score: ``unsupported`` (the claims of
    ``forbidden``, an array of wordings, that it makes, and "constraint_echo"), one boolean for each rule, and
    ``safe``. A null text is not safe; a null ``forbidden`` forbids nothing."""
    whole = F.coalesce(text, F.lit(""))
    echo = constraint_echo(whole, instructions, echoes)
    claims = F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda c: F.contains(whole, c))
    unsupported = F.concat(claims, F.when(echo, F.array(F.lit("constraint_echo"))).otherwise(F.array().cast("array<string>")))
    flags = {name: whole.rlike(p) for name, p in patterns.items()} | {"patient": whole.rlike(id_pattern), "wrist_score": whole.rlike(wrist)}
    bad = F.size(unsupported) > 0
    for flag in flags.values():
        bad = bad | flag
    return F.struct(unsupported.alias("unsupported"), *(c.alias(n) for n, c in flags.items()), echo.alias("constraint_echo"), (~bad & text.isNotNull()).alias("safe"))


def required_groups(bi: Column, tone: Column) -> Column:
    """What a recommendation must cover: daily living up to a Barthel index of 60, tone unless "0"."""
    return F.array_compact(F.array(F.lit("motor"), F.when(bi <= 60, "adl"), F.when(tone != "0", "tone")))


def covered(text: Column, required: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Whether every required group has one of its keywords in the text."""
    has = F.array_compact(F.array(*(F.when(contains_any(text, words), name) for name, words in keywords.items())))
    return F.size(F.array_except(required, has)) == 0


def safe_text(text: Column, safe: Column, complete: Column, policy: Column) -> Column:
    """The text only if it is known to be safe and complete; else the policy text."""
    return F.when(safe & complete, text).otherwise(policy)


def composed(facts: Column, advice: Column, fallback: Column, marker: str = r"^\s*(?:advice|recommendation)s?\s*:\s*") -> Column:
    """Facts and advice; a leading marker goes, empty advice takes the fallback, the end gets a full stop."""
    body = F.trim(F.regexp_replace(F.coalesce(advice, F.lit("")), "(?i)" + marker, ""))
    body = F.when(body == "", fallback).otherwise(body)
    return F.concat_ws("\n", facts, F.when(body.rlike(r"[.!?。！？]$"), body).otherwise(F.concat(body, F.lit("."))))


def fact_card(fma: Column, bi: Column, tone: Column, stage: Column) -> Column:
    """Tiers of the scores, values outside their ranges as flags, and what must not be said."""
    names = ("very_severe", "severe", "moderate", "mild", "near_normal")
    return F.struct(
        tier(fma, FMA_TIERS, names).alias("motor"), tier(bi, BI_TIERS, ("total", "severe", "moderate", "mild")).alias("dependence"), tier(stage, STAGE_TIERS, ("early", "middle", "late")).alias("stage"),
        F.array_compact(F.array(F.when(~fma.between(0, 20), "fma"), F.when(~bi.between(0, 100), "bi"), F.when(~stage.between(1, 6), "stage"))).alias("out_of_range"),
        F.array_compact(F.array(F.when(tone == "0", "spasticity"), F.when(bi > 60, "full_dependence"), F.when(fma <= 10, "full_recovery"))).alias("forbidden"),
    )


def chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Messages of one record; an empty reply is left out."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    reply = F.lit(None) if assistant is None else F.when(F.trim(assistant) != "", turn("assistant", assistant))
    return F.array_compact(F.array(turn("system", system), turn("user", user), *([reply] if assistant is not None else [])))


def rendered(messages: Column) -> Column:
    """Messages as one text. A record without messages, or whose text is blank, is an error when it is read."""
    text = _rendered(messages)
    empty = (F.coalesce(F.size(messages), F.lit(0)) < 1) | (F.trim(F.coalesce(text, F.lit(""))) == "")
    return F.when(empty, F.raise_error(F.lit("a record without messages")).cast("string")).otherwise(text)


def _rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def de_identified(text: Column, pattern: str = r"(?i)\b(?:patient|subject|case|id)[\s:_#-]*\d+\b|\b1\d{10}\b") -> Column:
    return F.regexp_replace(text, pattern, "[ID]")


def rating(value: Column) -> Column:
    """A whole score from 1 to 5; null otherwise."""
    n = F.trim(value.cast("string")).try_cast("int")
    return F.when(n.between(1, 5), n)


def metric_key(x: Column) -> Column:
    """1.5 as 1p5."""
    return F.replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", ""), F.lit("."), F.lit("p"))


# ---- cards and reports -----------------------------------------------------------------------

#: Wordings of a language; the defaults are English. A key of tiers holds one wording for each tier.
WORDS = {
    "motor": ("severely limited", "moderately limited", "mildly limited", "slightly limited", "near normal"),
    "dependence": ("highly dependent", "moderately dependent", "mostly independent", "independent"),
    "goal": ("take part with the affected hand and prepare grasping", "widen active movement and control grasping", "improve grasping and finger control", "improve fine and steady use"),
    "adl": ("use the hand in daily activities", "bring the hand into daily tasks safely"),
    "tone": ("mind muscle tone and quality of movement", "watch muscle tone"),
    "stage": "practise at hand stage %d",
    "pace": "adapt the load to what is tolerated",
}


def fact_section(subject: Column, age: Column, days: Column, side: Column, fma: Column, bi: Column, tone: Column, stage: Column, words: Mapping = WORDS) -> Column:
    """The sentences of a report that are said from the data alone."""
    return F.format_string(
        "Patient S%s, %d years, %d days since onset, %s side. FMA hand %d: %s; BI %d: %s. Tone %s, hand stage %d.",
        subject.cast("string"), age.cast("int"), days.cast("int"), F.when(side.isin("L", "left"), "left").when(side.isin("R", "right"), "right").otherwise(side),
        fma.cast("int"), tier(fma, FMA_TIERS, words["motor"]), bi.cast("int"), tier(bi, BI_TIERS, words["dependence"]), tone, stage.cast("int"),
    )


def policy_card(fma: Column, bi: Column, tone: Column, stage: Column, words: Mapping = WORDS) -> Column:
    """struct(goal, adl, tone, stage, pace, required): what a recommendation should say and must cover."""
    choose = lambda must, key: F.when(must, words[key][0]).otherwise(words[key][1])
    daily, tense = bi <= 60, F.trim(tone) != "0"
    return F.struct(
        tier(fma, FMA_TIERS[:3], words["goal"]).alias("goal"), choose(daily, "adl").alias("adl"), choose(tense, "tone").alias("tone"), F.format_string(words["stage"], stage.cast("int")).alias("stage"), F.lit(words["pace"]).alias("pace"),
        F.array_compact(F.array(F.lit("hand_goal"), F.lit("stage"), F.lit("pace"), F.when(daily, "adl"), F.when(tense, "tone"))).alias("required"),
    )


def policy_advice(card: Column) -> Column:
    """The clauses of a policy card that must be said, in its order."""
    has = lambda name: F.array_contains(card["required"], name)
    clauses = F.array_compact(F.array(card["goal"], card["stage"], F.when(has("adl"), card["adl"]), F.when(has("tone"), card["tone"]), card["pace"]))
    return F.concat(F.lit("Advice: "), F.array_join(clauses, "; "), F.lit("."))


def canonical_report(facts: Column, advice: Column) -> Column:
    return F.concat_ws(" ", facts, advice)


def structured_input(fma: Column, bi: Column, tone: Column, stage: Column) -> Column:
    """What reviewers are told about a case."""
    return F.format_string("FMA hand %d/20; BI %d/100; tone %s; hand stage %d.", fma.cast("int"), bi.cast("int"), F.trim(tone.cast("string")), stage.cast("int"))


def four_digits(value: Column) -> Column:
    """A metric as text; a missing one counts 0."""
    return F.format_string("%.4f", F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)))


def model_of(name: Column, registry: Sequence[tuple[str, str]]) -> Column:
    """Id of a model named by its id or by the last part of its path, whatever the case; null if unknown."""
    last = F.lower(F.element_at(F.split(F.rtrim(name, F.lit("/")), "/"), -1))
    out = F.lit(None).cast("string")
    for key, path in reversed(list(registry)):
        out = F.when((F.lower(name) == key.lower()) | (last == path.rstrip("/").split("/")[-1].lower()), key).otherwise(out)
    return out
