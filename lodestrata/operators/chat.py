"""Conversations: training pairs, history, titles, memories, answers' citations, rule judging and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T


def training_pairs(messages: DataFrame) -> DataFrame:
    """Each assistant message with the latest user message before it: a backward as-of join as one window.
    ``messages(conv_id, turn, role, text)``."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    user = F.last(F.when(F.col("role") == "user", F.struct("turn", "text")), ignorenulls=True).over(before)
    pairs = messages.withColumn("asked", user).where((F.col("role") == "assistant") & F.col("asked").isNotNull() & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    return pairs.select("conv_id", "turn", F.col("asked.turn").alias("user_turn"), F.col("asked.text").alias("instruction"), F.col("text").alias("output"))


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs fit for training: nothing blank, no broken encoding, no test instruction."""
    blank = (T.strip(F.coalesce("instruction", F.lit(""))) == "") | (T.strip(F.coalesce("output", F.lit(""))) == "")
    return pairs.where(~blank & ~T.mojibake(F.col("instruction")) & ~T.mojibake(F.col("output")) & ~F.lower(T.strip(F.col("instruction"))).isin(*C.TEST_INSTRUCTIONS))


def recent_context(messages: DataFrame, turns: int = C.HISTORY_TURNS) -> DataFrame:
    """Adds the messages before each one, at most two per turn, oldest first, and whether its pronouns call for them."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * turns, -1)
    history = F.collect_list(F.struct("role", "text")).over(before)
    return messages.withColumn("history", history).withColumn("rewrite", (F.size("history") > 0) & F.coalesce(T.contains_any(F.col("text"), C.PRONOUNS), F.lit(False)))


def titles(messages: DataFrame) -> DataFrame:
    """``(conv_id, title, messages, last_turn)``: the first question's first 36 characters."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(first.alias("q"), F.count("*").alias("messages"), F.max("turn").alias("last_turn")).select("conv_id", F.coalesce(F.substring(T.strip(F.col("q")), 1, 36), F.lit("新对话")).alias("title"), "messages", "last_turn")


def memories(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(memory_type, content, confidence, conv_id, turn)``: stated preferences of users, the first time each is stated,
    without those in ``known(memory_type, content)``."""
    text = F.coalesce("text", F.lit(""))
    has = lambda w: F.contains(text, F.lit(w))
    release = F.regexp_extract(text, "(?i)\\b(R20\\d{2}[ab])\\b", 1)
    project = F.regexp_extract(text, "(?:我的项目是|项目名叫|项目叫)[「『\"']?([^\\n，。,]{2,40})", 1)
    row = lambda kind, value, trust: F.struct(F.lit(kind).alias("memory_type"), value.alias("content"), F.lit(trust).alias("confidence"))
    rules = F.array_compact(F.array(
        F.when(release != "", row("simulink_release", F.concat(F.lit("用户主要使用 Simulink "), F.upper(release)), 0.98)),
        F.when(has("中文回答") | has("用中文"), row("response_style", F.lit("用户偏好中文回答"), 0.98)),
        F.when(has("简洁") & (has("回答") | has("风格")), row("response_style", F.lit("用户偏好简洁回答"), 0.85)),
        F.when(has("详细") & (has("回答") | has("步骤")), row("response_style", F.lit("用户偏好详细步骤"), 0.85)),
        F.when(project != "", row("project", F.concat(F.lit("当前项目："), T.strip(project)), 0.82)),
    ))
    found = messages.where("role = 'user'").select("conv_id", "turn", F.inline(rules))
    first = found.groupBy("memory_type", "content").agg(F.min(F.struct("conv_id", "turn")).alias("at"), F.max("confidence").alias("confidence"))
    out = first.select("memory_type", "content", "confidence", "at.conv_id", "at.turn")
    return out.join(known.select("memory_type", "content"), ["memory_type", "content"], "left_anti") if known is not None else out


def kept_paragraphs(answer: Column) -> Column:
    """A cited answer of several paragraphs without its uncited ones; short headings stay."""
    cited = lambda c: c.rlike("\\[E:\\d+\\]")
    parts = F.filter(F.transform(F.split(T.strip(answer), "\\n\\s*\\n"), T.strip), lambda p: p != "")
    kept = F.filter(parts, lambda p: cited(p) | ((F.length(p) <= 24) & ~p.rlike("[.!?。！？]")))
    return F.when(~cited(answer) | (F.size(parts) <= 1) | (F.size(kept) == 0), answer).otherwise(F.array_join(kept, "\n\n"))


def bound_citations(answers: DataFrame, fallback: int = 3) -> DataFrame:
    """``(answer_id, answer, cited)``: evidence whose marker stands in the answer; without any, the first ones are appended.
    ``answers(answer_id, answer, evidence array<long>)`` in evidence order."""
    text = kept_paragraphs(F.col("answer"))
    rows = answers.withColumn("text", text).withColumn("found", F.filter("evidence", lambda e: F.contains(F.col("text"), F.concat(F.lit("[E:"), e.cast("string"), F.lit("]")))))
    refs = F.array_join(F.transform(F.slice("evidence", 1, fallback), lambda e: F.concat(F.lit("[E:"), e.cast("string"), F.lit("]"))), " ")
    bare = (F.size("found") == 0) & (F.size("evidence") > 0)
    repaired = F.concat(F.regexp_replace("text", "(?U)\\s+$", ""), F.lit("\n\n主要依据："), refs)
    return rows.select("answer_id", F.when(bare, repaired).otherwise(F.col("text")).alias("answer"), F.when(bare, F.slice("evidence", 1, fallback)).otherwise(F.col("found")).alias("cited"))


def judged(answers: DataFrame, threshold: float = C.JUDGE_THRESHOLD) -> DataFrame:
    """Rule scores of ``answers(answer, context)``, the judge's own verdict and the final one (all four reach the bar)."""
    cites = F.col("answer").rlike("\\[E:\\d+\\]")
    refuses = T.contains_any(F.col("answer"), C.REFUSALS)
    out = answers.withColumn("citation_coverage", F.when(cites, 1.0).otherwise(0.0))
    out = out.withColumn("retrieval_sufficiency", F.when(~refuses & (T.strip(F.coalesce("context", F.lit(""))) != ""), 1.0).otherwise(0.0))
    out = out.withColumn("faithfulness", F.when(cites, 0.75).otherwise(0.35)).withColumn("completeness", F.when(F.length(T.strip(F.col("answer"))) >= 80, 0.75).otherwise(0.45))
    three = F.least("retrieval_sufficiency", "citation_coverage", "completeness")
    return out.withColumn("judge_passed", three >= threshold).withColumn("passed", F.least(three, F.col("faithfulness")) >= threshold)


def preview_flags(mode: Column, kind: Column, question: Column, answer: Column, citations: Column, total_ms: Column) -> Column:
    rag = mode == "rag"
    return F.array_compact(F.array(
        F.when(rag & (citations == 0), "missing_citations"),
        F.when(rag & (T.chinese_ratio(answer) < 0.25) & question.rlike("[\\u4e00-\\u9fff]"), "mostly_not_chinese"),
        F.when(rag & (total_ms > 20000), "slow_over_20s"),
        F.when(rag & (F.length(answer) > 1200), "too_long"),
        F.when((kind == "boundary") & (mode != "refusal"), "boundary_not_refused"),
        F.when((mode == "refusal") & (kind != "boundary"), "unexpected_refusal"),
    ))


def quality_flags(kind: Column, answer: Column, citations: Column, covered: Column, must_include: Column) -> Column:
    refusal, low = kind == "refusal", F.lower(answer)
    worded = reduce(lambda a, b: a | b, (F.contains(answer, F.lit(w)) for w in (*C.REFUSALS, "没有足够证据")))
    base = F.array_compact(F.array(
        F.when(refusal & covered, "expected_refusal_but_coverage_passed"),
        F.when(refusal & ~worded, "refusal_wording_missing"),
        F.when(~refusal & ~covered, "coverage_failed_for_answerable"),
        F.when(~refusal & (citations == 0), "missing_citations"),
        F.when(~refusal & (T.chinese_ratio(answer) < 0.25), "mostly_not_chinese"),
    ))
    missing = F.transform(F.filter(must_include, lambda t: ~F.contains(low, F.lower(t))), lambda t: F.concat(F.lit("missing_expected_term:"), t))
    return F.when(refusal, base).otherwise(F.concat(base, missing))


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall_at_k, precision_at_k, reciprocal_rank)`` of ``results(query_id, item, rank)`` against
    ``relevant(query_id, item)``."""
    good = relevant.select("query_id", "item").distinct().withColumn("good", F.lit(True))
    rows = results.join(good, ["query_id", "item"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    hits = F.count_if(F.col("good") & (F.col("rank") <= k))
    first = F.min(F.when(F.col("good"), F.col("rank")))
    return rows.groupBy("query_id").agg(F.when(hits > 0, 1.0).otherwise(0.0).alias("recall_at_k"), (hits / k).alias("precision_at_k"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"))
