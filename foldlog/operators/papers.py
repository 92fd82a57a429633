"""Papers: the operational state of sectioned excerpts, its compact form and replay, and what of it survives.

An excerpt is a text with lines `TITLE: ..` and `SECTION: name`. A state is a row with an ARRAY<STRING> of sorted keywords a
text field, and the entities; states are made row by row, without a shuffle. Sentences and lines become rows only where evidence
names them by locator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.numbers import failure_labels, merged_labels
from foldlog.functions.text import LINE_BREAK, keywords, once, one_space, overlap, sentences, word_count
from foldlog.operators.audit import evidence_survival

# Sections and fields, keyword budgets, shares that must survive, words and patterns that results depend on.
SECTIONS = ["problem", "method", "metrics", "limitations", "deployment_relevance"]
BUDGETS = {"problem": 18, "method": 22, "metrics": 24, "limitations": 18, "deployment_relevance": 18, "baselines": 18}
TEXTS = list(BUDGETS)
FIELDS = [*TEXTS, "entities", "required_entities"]
THRESHOLDS = {"problem": 0.60, "method": 0.55, "metrics": 0.70, "limitations": 0.70, "deployment_relevance": 0.60, "baselines": 0.50, "entities": 1.0, "required_entities": 1.0}
EVIDENCE_OVERLAP = 0.60
ENTITIES_KEPT = 0.80
STOP_WORDS = (
    "a an and are as because but by can do does for from how in include into is it may not of on only or rather such than that the then this to what when where whether while with"
).split()
BASELINE_WORDS = ["baseline", "compares", "compare", "against", "rather than", "instead of", "retrieval", "compression", "memory systems"]
ENTITY = r"(?U)\b(?:[A-Z][A-Za-z0-9]*(?:[-_][A-Z]?[A-Za-z0-9]+)*|[A-Z]{2,}[A-Za-z0-9-]*|[a-z]+\s+DAG|execution\s+state|model\s+residency|prefix\s+reuse|device\s+reachability)\b"
ENTITY_MARKS = ".,;:()[]{}"
#: Line breaks but the newline.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
AVERAGES = ["compression_ratio", "entity_retention_rate", "evidence_survival_rate", "high_critical_evidence_survival_rate", "limitation_survival_rate", "metric_survival_rate", "replay_consistency", "section_survival_rate"]
#: Shares of a retention score: entities, sections, context, equal replay.
AUDIT = [0.45, 0.20, 0.15, 0.20]


def no_texts() -> Column:
    return F.array().cast("array<string>")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def plain_breaks(text: Column) -> Column:
    """The text with every line break as a newline; most texts have no others."""
    said = F.coalesce(text, F.lit(""))
    return F.when(reduce(lambda a, b: a | b, [F.contains(said, F.lit(x)) for x in OTHER_BREAKS]), F.regexp_replace(said, LINE_BREAK, "\n")).otherwise(said)


def blocks(plain: Column) -> Column:
    """The sections of a text of plain_breaks(), what stands before them first: each its head and what follows it, if anything."""
    return F.transform(F.split(plain, "\n(?=SECTION: )", -1), lambda b: F.split(b, "\n", 2))


def section_of(found: Column, name: str) -> Column:
    """The lines of the last of blocks() of that name, joined, with single spaces; empty without one."""
    last = F.try_element_at(F.filter(found, lambda b: F.trim(b[0]) == F.lit(f"SECTION: {name}")), F.lit(-1))
    return one_space(F.try_element_at(last, F.lit(2)))


def section(text: Column, name: str) -> Column:
    return section_of(blocks(plain_breaks(text)), name)


def title(text: Column) -> Column:
    """Of a text of plain_breaks()."""
    return F.trim(F.regexp_extract(text, r"(?m)^TITLE: (.*)$", 1))


def by_letters(names: Column) -> Column:
    """Distinct texts in alphabetical order, letters of either case alike, upper case first."""
    return F.transform(F.sort_array(F.transform(F.array_distinct(names), lambda x: F.struct(F.lower(x).alias("l"), x.alias("x")))), lambda s: s["x"])


def canonical_entity(name: Column) -> Column:
    return F.btrim(one_space(name), F.lit(ENTITY_MARKS))


def required_present(required: Column, text: Column) -> Column:
    there = once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(F.coalesce(required, no_texts()), lambda e: F.contains(low, F.lower(e))))
    return by_letters(F.transform(there, canonical_entity))


def entities(text: Column, required: Column) -> Column:
    """The required entities that are there, and what the text writes like an entity."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)), canonical_entity)
    kept = F.filter(F.array_distinct(found), lambda e: (F.char_length(e) > 1) & ~F.lower(e).isin(STOP_WORDS))
    return by_letters(F.array_union(required, kept))


def baseline_sentences(text: Column) -> Column:
    """The sentences of the whole text that speak of baselines; a text that does not is not split."""
    speaks = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in BASELINE_WORDS])
    told = lambda said: F.transform(F.filter(F.transform(said, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"))), lambda x: speaks(x["low"])), lambda x: x["s"])
    return once(one_space(text), lambda flat: F.when(once(F.lower(flat), speaks), told(sentences(flat))).otherwise(no_texts()))


def kept_entities(names: Column, required: Column) -> Column:
    """All required entities, and the first four fifths of the others, one at least."""
    rest = F.array_except(names, required)
    most = F.greatest(F.lit(1), F.bround(F.size(rest) * ENTITIES_KEPT).cast("int"))
    return by_letters(F.concat(F.array_intersect(names, required), F.slice(rest, 1, most)))


def paper_states(df: DataFrame, id_col: str, text_col: str, required_col: str) -> DataFrame:
    """(id, title, a column a field) of excerpts; required_col: ARRAY<STRING> of entities that should be there.

    Null and empty texts, and texts without sections, have empty fields. Of sections of one name the last counts. Texts of
    any length are read whole, each in its own row. Repeated ids are rows of their own. Extra columns are not carried.
    """
    return with_states(df.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"), F.col(required_col).alias("_required")), "_text", "_required").select(id_col, "title", *FIELDS)


def with_states(df: DataFrame, text_col: str, required_col: str) -> DataFrame:
    """df with `title`, a column a field, and `_blocks`, the sections of its texts: a text is split once for all of them."""
    text = F.col(text_col)
    set_of = lambda said: F.sort_array(keywords(said, STOP_WORDS))
    plain = df.withColumn("_plain", plain_breaks(text))
    split = plain.withColumns({"title": title(F.col("_plain")), "_blocks": blocks(F.col("_plain")), "required_entities": required_present(F.col(required_col), text)}).drop("_plain")
    return split.withColumns({
        **{s: set_of(section_of(F.col("_blocks"), s)) for s in SECTIONS}, "baselines": set_of(F.array_join(baseline_sentences(text), " ")), "entities": entities(text, F.col("required_entities")),
    })


def compact_paper(states: DataFrame, id_col: str, budgets: dict[str, int] | None = None) -> DataFrame:
    """(id, a column a field): the first keywords of each field within its budget, and the entities that are kept."""
    return states.select(id_col, *(c.alias(f) for f, c in compact_columns(budgets).items()))


def compact_columns(budgets: dict[str, int] | None = None) -> dict[str, Column]:
    budgets = budgets or BUDGETS
    return {**{f: F.slice(f, 1, budgets[f]) for f in TEXTS}, "entities": kept_entities(F.col("entities"), F.col("required_entities")), "required_entities": F.col("required_entities")}


def compact_json(id_col: str, prefix: str = "") -> Column:
    """A compact state, whose columns have a prefix, as JSON text with keys in order."""
    fields = F.struct(*(F.col(f"{prefix}{f}").alias(f) for f in sorted(FIELDS)))
    return F.to_json(F.struct(fields.alias("f"), F.col(id_col).cast("string").alias("p")))


def replay_json(fields: list[Column], name: Column, paper_id: Column, title_text: Column) -> Column:
    return F.to_json(F.struct(F.struct(*fields).alias("operational_fields"), name.alias("paper"), paper_id.cast("string").alias("paper_id"), title_text.alias("title")))


def survives(field: str, original: Column, again: Column) -> Column:
    """Whether enough of a field came back, by the field's own threshold; an empty field survives never."""
    there = F.size(original) > 0
    if field == "required_entities":
        return there & (original == again)
    return there & (overlap(original, again) >= THRESHOLDS[field])


def spoken(texts: Column) -> Column:
    """Keywords of a text or of a field."""
    return keywords(texts, STOP_WORDS)


def paper_sources(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, locator, value): each sentence of a section as `section:k`, each line that is not blank as `line:k`, from 0."""
    rows = df.select(id_col, plain_breaks(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_blocks", blocks(F.col("_text")))
    return rows.select(id_col, F.explode(sources(F.col("_text"), F.col("_blocks"))).alias("p")).select(id_col, "p.*")


def sources(text: Column, found: Column, names: list[str] | None = None) -> Column:
    """ARRAY<STRUCT<locator, value>> of the sentences and lines of a text whose blocks() are `found`; of the named kinds alone, if given."""
    placed = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.concat(F.lit(f"{kind}:"), i.cast("string")).alias("locator"), x.alias("value")))
    lines = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != "")
    kinds = {**{s: lambda s=s: sentences(section_of(found, s)) for s in SECTIONS}, "line": lambda: lines}
    return F.concat(*(placed(k, of()) for k, of in kinds.items() if names is None or k in names))


def evidence_sides(evidence: DataFrame, papers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, evidence_id, value): the keywords of the sentence or line that each piece of evidence names, where it is there."""
    wanted = evidence.select(id_col, "evidence_id", F.trim("locator").alias("locator"))
    return wanted.join(paper_sources(papers, id_col, text_col), [id_col, "locator"]).select(id_col, "evidence_id", spoken(F.col("value")).alias("value"))


def replayed_sides(evidence: DataFrame, replayed: DataFrame, id_col: str) -> DataFrame:
    """(id, evidence_id, value): the keywords of the replayed field that the evidence's section names; a line has no field."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS)))
    sides = replayed.select(id_col, fields.alias("x")).select(id_col, "x.*")
    named = evidence.where(F.contains("locator", F.lit(":"))).select(id_col, "evidence_id", F.trim(F.substring_index("locator", ":", 1)).alias("field"))
    return named.join(sides, [id_col, "field"]).select(id_col, "evidence_id", spoken(F.array_join("value", " ")).alias("value"))


def with_named(df: DataFrame, text_col: str, names: list[str] | None = None) -> DataFrame:
    """df with `_named`: of each entry of its `evidence`, whether it is HIGH, its field, and the keywords of the sentence or line it names.

    df: a text, its `_blocks` (see with_states()), and `evidence`, ARRAY<STRUCT<locator, criticality>>. Null stays null. names: the kinds
    of sources that any locator names, if known. Nothing is shuffled: a row's evidence is found in the row's own text.
    """
    wanted = lambda e: F.transform(e, lambda x: F.trim(x["locator"]))
    there = once(wanted(F.col("evidence")), lambda w: F.filter(sources(plain_breaks(F.col(text_col)), F.col("_blocks"), names), lambda p: F.array_contains(w, p["locator"])))
    found = df.withColumn("_there", F.transform(F.when(F.col("evidence").isNotNull(), there), lambda p: F.struct(p["locator"].alias("locator"), spoken(p["value"]).alias("value"))))
    of = lambda e: F.try_element_at(F.filter("_there", lambda p: p["locator"] == F.trim(e["locator"])), F.lit(1))["value"]
    field = lambda e: F.when(F.contains(e["locator"], F.lit(":")), F.trim(F.substring_index(e["locator"], ":", 1)))
    told = lambda e: F.struct(F.coalesce(F.upper(F.trim(e["criticality"])) == "HIGH", F.lit(False)).alias("high"), field(e).alias("field"), of(e).alias("o"))
    return found.withColumn("_named", F.transform("evidence", told)).drop("_there")


def survival_in_row(named: Column, prefix: str = "") -> Column:
    """STRUCT<total, survived, h, hs> of with_named() against the replayed fields in columns of a prefix: evidence, and HIGH evidence; null without any."""
    again = lambda name: reduce(lambda out, f: out.when(name == f, F.col(f"{prefix}{f}")), FIELDS[1:], F.when(name == FIELDS[0], F.col(f"{prefix}{FIELDS[0]}")))
    ok = lambda e: F.coalesce(overlap(e["o"], spoken(F.array_join(again(e["field"]), " "))) >= EVIDENCE_OVERLAP, F.lit(False)) & e["o"].isNotNull() & again(e["field"]).isNotNull()
    judged = F.transform(named, lambda e: F.struct(e["high"].alias("high"), ok(e).alias("ok")))
    n = lambda x, hit: F.size(F.filter(x, hit)).cast("long")
    return F.when(F.size(named) > 0, once(judged, lambda x: F.struct(F.size(x).cast("long").alias("total"), n(x, lambda e: e["ok"]).alias("survived"), n(x, lambda e: e["high"]).alias("h"), n(x, lambda e: e["high"] & e["ok"]).alias("hs"))))


def survival_columns(counts: str) -> list[Column]:
    """The columns of evidence_survival() from a column of survival_in_row()."""
    at = lambda c: F.col(f"{counts}.{c}")
    rate = lambda a, b: F.round(F.when(at(b) > 0, at(a) / at(b)).when(at("total").isNotNull(), 0.0), 6)
    return [at("total").alias("evidence_total"), at("survived").alias("evidence_survived"), rate("survived", "total").alias("evidence_survival_rate"), (at("h") > 0).alias("has_high"), rate("hs", "h").alias("high_survival_rate")]


def paper_evidence(evidence: DataFrame, papers: DataFrame, replayed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """evidence_survival() of locators: the original side is a sentence or line, the replayed side the section's field.

    evidence: (id, evidence_id, locator, criticality). A line has no replayed side. Sides match from an overlap of keywords of
    EVIDENCE_OVERLAP. Locators that name nothing find nothing; evidence ids are unique within a paper.
    """
    original, again = evidence_sides(evidence, papers, id_col, text_col), replayed_sides(evidence, replayed, id_col)
    return evidence_survival(evidence, original, again, id_col, overlap(F.col("o"), F.col("r")) >= EVIDENCE_OVERLAP)


def paper_validation(original: DataFrame, again: DataFrame, compact: DataFrame, papers: DataFrame, evidence: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a paper: what survived of its evidence, entities, sections, metrics and limitations, and tokens before and after.

    A paper without evidence has rates of 0 and the flag has_evidence false, and no label for it.
    """
    found = paper_evidence(evidence, papers, again, id_col, text_col)
    right = again.select(id_col, *(F.col(f).alias(f"_{f}") for f in FIELDS))
    sizes = compact.select(id_col, word_count(compact_json(id_col)).alias("compact_token_count"))
    read = papers.select(id_col, word_count(F.col(text_col)).alias("original_token_count"))
    return validation_rows(original.join(right, id_col).join(sizes, id_col).join(read, id_col).join(found, id_col, "left"), id_col)


def validation_rows(joined: DataFrame, id_col: str) -> DataFrame:
    """paper_validation() of rows that hold a state, its replay under names with "_", the tokens and evidence_survival()."""
    held = {f: survives(f, F.col(f), F.col(f"_{f}")).cast("int") for f in FIELDS}
    share = lambda names: F.round(reduce(lambda a, b: a + b, [held[f] for f in names]) / len(names), 6)
    rate = lambda f: F.round(overlap(F.col(f), F.col(f"_{f}")), 6)
    total, kept = (F.coalesce(c, F.lit(0)) for c in ("evidence_total", "evidence_survived"))
    again_fields = [(F.col(f"_{f}") if f.endswith("entities") else F.array_join(f"_{f}", " ")).alias(f) for f in sorted(FIELDS)]
    rows = joined.select(
        id_col, F.coalesce("evidence_survival_rate", F.lit(0.0)).alias("evidence_survival_rate"), F.coalesce("high_survival_rate", F.lit(0.0)).alias("high_critical_evidence_survival_rate"), kept.alias("evidence_survived"), total.alias("evidence_total"),
        (total > 0).alias("has_evidence"), F.coalesce("has_high", F.lit(False)).alias("has_high_critical_evidence"), rate("entities").alias("entity_retention_rate"), share(TEXTS).alias("section_survival_rate"), rate("limitations").alias("limitation_survival_rate"),
        rate("metrics").alias("metric_survival_rate"), F.when(F.col("compact_token_count") > 0, F.round(F.col("original_token_count") / F.col("compact_token_count"), 6)).otherwise(0.0).alias("compression_ratio"),
        share(FIELDS).alias("replay_consistency"), "original_token_count", "compact_token_count", word_count(replay_json(again_fields, F.col("title"), F.col(id_col), F.col("title"))).alias("replay_token_count"),
    )
    one = F.lit(1.0)
    labels = failure_labels(F.col("has_evidence"), F.col("evidence_survived"), F.col("evidence_total"), F.col("evidence_survival_rate"), F.col("has_high_critical_evidence"), F.col("high_critical_evidence_survival_rate"), one, one)
    return rows.withColumn("failure_labels", labels)


def validation_summary(rows: DataFrame, averages: list[str] | None = None, count: str = "paper_count") -> DataFrame:
    """One row over validation rows: their averages, the labels any of them has, their number; zeros without rows."""
    averages = averages or AVERAGES
    return rows.agg(*(F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(f"avg_{c}") for c in averages), merged_labels(F.collect_set("failure_labels")).alias("failure_labels"), F.count("*").alias(count))


def retention_audit(states: DataFrame, again: DataFrame, id_col: str, sections: list[str], required: str = "required_entities") -> DataFrame:
    """(id, lost, sections_kept, context_kept, replay_equal, score, passed): whether a typed state came back whole.

    Entities are lost that the replayed state holds nowhere; sections are kept if each has words again, context if the title is
    there, replay is equal if every field is. The score adds their AUDIT shares, rounded to two places.
    """
    right = again.select(id_col, *(F.col(f).alias(f"_{f}") for f in FIELDS))
    return retention_rows(states.join(right, id_col), id_col, sections, required)


def retention_rows(both: DataFrame, id_col: str, sections: list[str], required: str = "required_entities") -> DataFrame:
    """retention_audit() of rows that hold a state, and its replay under names with "_"."""
    everything = F.lower(F.array_join(F.concat(*(F.col(f"_{f}") for f in FIELDS)), " "))
    lost = once(everything, lambda said: F.filter(F.col(required), lambda e: ~F.contains(said, F.lower(e))))
    held = reduce(lambda a, b: a & b, [F.size(f"_{s}") > 0 for s in sections])
    equal = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"_{f}") for f in FIELDS])
    told = both.select(id_col, required, lost.alias("lost"), held.alias("sections_kept"), (F.col("title") != "").alias("context_kept"), equal.alias("replay_equal"))
    entity = F.when(F.size(required) > 0, 1 - F.size("lost") / F.size(required)).otherwise(1.0)
    score = F.round(sum(s * c for s, c in zip(AUDIT, [entity, *(F.col(c).cast("int") for c in ("sections_kept", "context_kept", "replay_equal"))])), 2)
    passed = (F.size("lost") == 0) & F.col("sections_kept") & F.col("context_kept") & F.col("replay_equal")
    return told.select(id_col, "lost", "sections_kept", "context_kept", "replay_equal", score.alias("score"), passed.alias("passed"))
