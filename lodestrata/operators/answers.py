"""What goes to a model and what comes back: prompts, texts without enough evidence, tolerant JSON, extracted graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T


def contract(role: Column) -> Column:
    """How long and in which form an answer of a role may be."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in C.CONTRACTS.items() for x in pair]), role), F.lit(C.CONTRACTS["general"]))


def prompts(questions: DataFrame, context: DataFrame, history: DataFrame | None = None, memories: DataFrame | None = None, turns: int = C.PROMPT_TURNS) -> DataFrame:
    """``(query_id, role, token_budget, prompt)`` of ``questions(query_id, text)``: preferences, the last ``turns`` messages, the
    question and its evidence ``context(query_id, context)``. ``history(query_id, at, role, text)``;
    ``memories(query_id, at, content)``."""
    role = T.question_role(F.col("text"))
    rows = questions.select("query_id", "text", role.alias("role")).join(context, "query_id", "left")
    none = F.lit(C.NOTHING)
    if history is not None:
        last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("at")))
        line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
        told = history.withColumn("rn", last).where(F.col("rn") <= turns).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))
        rows = rows.join(told, "query_id", "left")
    else:
        rows = rows.withColumn("history", F.lit(None).cast("string"))
    if memories is not None:
        line = F.concat(F.lit("- "), "content")
        kept = memories.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("memories"))
        rows = rows.join(kept, "query_id", "left")
    else:
        rows = rows.withColumn("memories", F.lit(None).cast("string"))
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(F.col(c))
    filled = F.format_string(C.PROMPT.replace("%", "%%").replace("{}", "%s"), contract(F.col("role")), blank("memories"), blank("history"), F.col("text"), F.coalesce("context", F.lit("")))
    return rows.select("query_id", "role", T.by_role(F.col("role"), C.ROLE_BUDGETS).alias("token_budget"), T.strip(filled).alias("prompt"))


def uncovered_answer(missing: Column) -> Column:
    """The answer where evidence lacks required terms."""
    named = F.when(F.size(missing) > 0, F.array_join(missing, C.LIST_MARK)).otherwise(F.lit(C.KEY_TERMS_TEXT))
    return F.format_string(C.UNCOVERED.replace("{}", "%s"), named)


def nothing_found_answer(filtered: Column, variants: Column) -> Column:
    """The answer where nothing was found: hints by whether sources were filtered and which variants were searched."""
    first, unfilter, searched, load_more = C.NOTHING_FOUND
    lines = F.array_compact(F.array(F.lit(first), F.when(filtered, F.lit(unfilter)), F.when(F.size(variants) > 0, F.format_string(searched.replace("{}", "%s"), F.array_join(variants, " / "))), F.lit(load_more)))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def json_text(text: Column) -> Column:
    """The JSON object in a model's output: of a fence if there is one, else from the first brace to the last; as it stands
    without braces."""
    value = T.strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(value, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    bare = F.regexp_extract(value, "(?s)\\{.*\\}", 0)
    return F.when(fenced != "", fenced).when(bare != "", bare).otherwise(value)


_EXTRACTED = "entities array<struct<label:string,type:string,confidence:double>>, relations array<struct<source:string,target:string,type:string,label:string,confidence:double>>"


def json_fields(text: Column, schema: str) -> Column:
    """The fields of the JSON object in an output; null where it doesn't parse."""
    return F.from_json(json_text(text), schema)


def extracted(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities ``(page_id, at, entity_key, label, entity_type, confidence)`` and relations ``(page_id, at, source_key,
    target_key, relation_type, label, confidence)`` that a model's ``outputs(page_id, answer)`` state: valid labels, known
    types, confidence in 0 to 1, no relation of an entity to itself, at most 12 and 10 of a page."""
    rows = outputs.select("page_id", json_fields(F.col("answer"), _EXTRACTED).alias("x"))
    one = lambda c, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(default)).otherwise(c)))
    first = lambda df, most: df.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("rn") <= most).drop("rn")
    named = lambda c: T.canonical_label(F.coalesce(c, F.lit("")))
    e = rows.select("page_id", F.posexplode("x.entities").alias("at", "e")).where("e is not null")
    e = e.select("page_id", "at", named(F.col("e.label")).alias("label"), F.when(F.col("e.type").isin(*C.ENTITY_TYPES), F.col("e.type")).otherwise("concept").alias("entity_type"), one(F.col("e.confidence"), 0.72).alias("confidence"))
    e = first(e.where(T.valid_label(F.col("label"))), 12).withColumn("entity_key", T.slug(F.col("label")))
    r = rows.select("page_id", F.posexplode("x.relations").alias("at", "r")).where("r is not null")
    stated = F.coalesce("r.type", F.lit("relates_to"))
    kind = F.when(stated.isin(*C.RELATION_TYPES), stated).otherwise("relates_to")
    said = T.clean_label(F.coalesce("r.label", stated))
    r = r.select("page_id", "at", named(F.col("r.source")).alias("source"), named(F.col("r.target")).alias("target"), kind.alias("relation_type"), F.when(said != "", said).otherwise(stated).alias("label"), one(F.col("r.confidence"), 0.65).alias("confidence"))
    r = r.where(T.valid_label(F.col("source")) & T.valid_label(F.col("target"))).withColumn("source_key", T.slug(F.col("source"))).withColumn("target_key", T.slug(F.col("target"))).where("source_key <> target_key")
    return e.select("page_id", "at", "entity_key", "label", "entity_type", "confidence"), first(r, 10).select("page_id", "at", "source_key", "target_key", "relation_type", "label", "confidence")
