"""Rows that change: upserts, updates, deletes with their children, point lookups, lists. Parquet has no row-level writes, so
every operator takes whole tables and returns whole tables; joins are on keys and nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T


def upserted(table: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of the same keys; of several new rows the last by ``order``."""
    if order is not None:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("rn", last).where("rn = 1").drop("rn")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*table.columns))


def replaced(table: DataFrame, new: DataFrame, group: str, gone: DataFrame | None = None) -> DataFrame:
    """``table`` where every group that ``new`` has is replaced as a whole, and the groups in ``gone`` are left out: the vector
    index after documents were indexed again or deleted."""
    drop = new.select(group).union(gone.select(group)) if gone is not None else new.select(group)
    return table.join(drop.distinct(), group, "left_anti").unionByName(new.select(*table.columns))


def deleted(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """The parents without ``ids`` and each child table ``(rows, foreign key)`` without theirs."""
    out = {"parents": parents.join(ids.select(key), key, "left_anti")}
    for name, (rows, foreign) in children.items():
        out[name] = rows.join(ids.select(F.col(key).alias(foreign)), foreign, "left_anti")
    return out


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the values of ``changes`` that aren't null, by key; unknown keys are ignored."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return table.join(new, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def looked_up(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` keys, and wanted keys that there are none for (``found`` false): an answer for each."""
    return wanted.select(key).distinct().join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def listed(table: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """A list endpoint: rows with their place, newest or pinned first; ``limit`` if the list is capped."""
    if limit is not None:
        table = table.orderBy(*order).limit(limit)
    # a capped list is one page; without a cap, places are given per page of a range partitioning by the caller
    return table.withColumn("place", F.row_number().over(Window.orderBy(*order))) if limit is not None else table.orderBy(*order)


def page_filter(pages: DataFrame, page_type: str | None = None, status: str | None = None, needle: str = "") -> DataFrame:
    """Pages of a type and status whose title, slug, type or status holds the needle."""
    rows = pages
    if page_type:
        rows = rows.where(F.col("page_type") == page_type)
    if status:
        rows = rows.where(F.col("status") == status)
    needle = needle.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "slug", "page_type", "status")), F.lit(needle))) if needle else rows


def unasked(questions: DataFrame, messages: DataFrame) -> DataFrame:
    """Acceptance questions ``(question)`` that no user message has asked yet: a rerun asks only what is missing."""
    asked = messages.where("role = 'user'").select(T.strip(F.col("text")).alias("question")).distinct()
    return questions.withColumn("question", T.strip(F.col("question"))).join(asked, "question", "left_anti")


def retried(answers: DataFrame, again: DataFrame, threshold: float = C.JUDGE_THRESHOLD) -> DataFrame:
    """One regeneration of unfaithful answers: ``answers(answer_id, answer, faithfulness)`` under the bar take the answer of
    ``again(answer_id, answer, faithfulness)`` whatever its score, and say so."""
    new = again.select("answer_id", F.col("answer").alias("new_answer"), F.col("faithfulness").alias("new_faithfulness"))
    rows = answers.join(new, "answer_id", "left").withColumn("retried", (F.col("faithfulness") < threshold) & F.col("new_answer").isNotNull())
    return rows.select("answer_id", F.when(F.col("retried"), F.col("new_answer")).otherwise(F.col("answer")).alias("answer"), F.when(F.col("retried"), F.col("new_faithfulness")).otherwise(F.col("faithfulness")).alias("faithfulness"), "retried")


def answer_metrics(results: DataFrame) -> DataFrame:
    """One row of the remaining measures over ``results(domains, found_domains, dense_share, cited, paragraphs, refused,
    should_refuse, points, covered_points)``: domain accuracy and wrong-domain rate (of questions with a domain), the vector
    channel's contribution, citation coverage, completeness, refusal accuracy and false refusals."""
    share = lambda hit, of: F.round(F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)), 6)
    some = F.size("domains") > 0
    met = F.size(F.array_intersect("domains", "found_domains")) > 0
    answered, every = ~F.col("refused"), F.lit(True)
    return results.agg(
        share(met, some).alias("domain_accuracy"), share(~met & (F.size("found_domains") > 0), some).alias("wrong_domain_rate"), F.round(F.coalesce(F.avg("dense_share"), F.lit(0.0)), 6).alias("dense_contribution"),
        F.round(F.coalesce(F.sum(F.when(answered, F.col("cited"))) / F.nullif(F.sum(F.when(answered, F.col("paragraphs"))), F.lit(0)), F.lit(0.0)), 6).alias("citation_coverage"),
        F.round(F.coalesce(F.sum(F.when(answered, F.col("covered_points"))) / F.nullif(F.sum(F.when(answered, F.col("points"))), F.lit(0)), F.lit(0.0)), 6).alias("completeness"),
        share(F.col("refused"), F.col("should_refuse")).alias("refusal_accuracy"), share(F.col("refused"), every & ~F.col("should_refuse")).alias("false_refusal_rate"),
    )
