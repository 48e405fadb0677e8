import uuid

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens_of_mixed_text(spark):
    assert one(spark, T.lexical_tokens(F.col("t")), t="R2025a find_system 怎么 怎么用 step. step.") == ["r2025a", "find_system", "怎么", "么用", "step."]
    assert one(spark, T.index_terms(T.lexical_tokens(F.col("t"))), t="find_system a-b ...") == ["find", "system", "a", "b"]


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("abcd", 1), ("abcde", 2), ("仿真模型", 4), ("仿真 model", 4)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, T.estimate_tokens(F.col("t")), t=text) == tokens


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="第一句。第二句！Third one. Fourth; fifth e.g. lower\n\nNext") == ["第一句。", "第二句！", "Third one.", "Fourth;", "fifth e.g. lower", "Next"]


def test_citations_and_links(spark):
    text = "a [E:3] b [[ E : 7 ]] c [E:3] [[Solver]] [[ Chart ]] [[E:9]]"
    assert one(spark, T.citations(T.normalize_citations(F.col("t"))), t=text) == [3, 7, 9]
    assert one(spark, T.wiki_links(F.col("t")), t=text) == ["Chart", "Solver"]
    assert one(spark, T.evidence_refs(F.col("t")), t='["E:4", "[E: 5]", "x"]') == [4, 5]
    assert one(spark, T.evidence_refs(F.col("t")), t="E:6") == [6]
    assert one(spark, T.evidence_refs(F.col("t")), t="broken [") == []


def test_labels(spark):
    assert one(spark, T.canonical_label(F.col("t")), t="  **AUTOSAR components**: ") == "AUTOSAR Component"
    for label, ok in {"AUTOSAR Component": True, "the": False, "Page 3": False, "E:4": False, "1.2": False, "ab": False, "bus": True, "a/b": False, "Simulink/AUTOSAR": True, "Modèle": False}.items():
        assert one(spark, T.valid_label(F.col("t")), t=label) is ok, label
    assert one(spark, T.entity_type(F.col("t")), t="Embedded strategy") == "method"
    assert one(spark, T.slug(F.col("t")), t="AUTOSAR Component!") == "autosar-component"
    assert one(spark, T.slug(F.col("t")), t="仿真") == "entity-" + "仿真".encode().hex()


def test_roles_and_domains(spark):
    assert one(spark, T.domains(F.col("t")), t="Simulink 和 AUTOSAR 的关系") == ["autosar", "simulink"]
    for text, role in {"Simulink 和 AUTOSAR 的关系": "relationship", "compare a and b": "comparison", "怎么做": "procedure", "what is a bus": "definition", "bus": "general"}.items():
        assert one(spark, T.question_role(F.col("t")), t=text) == role


def test_intents(spark):
    for text, intent in {"你好啊！": "greeting", "你是谁？": "identity", "怎么用": "capabilities", "怎么上传文件": "upload_help", "今天天气": "out_of_scope_chat", "which": "greeting", "求解器怎么选择": "rag", "Simulink 怎么用": "capabilities"}.items():
        assert one(spark, T.intent(F.col("t")), t=text) == intent, text


def test_required_terms(spark):
    assert one(spark, T.required_terms(F.col("t")), t="Can Simulink generate ROS_2 nodes 123 directly") == ["ros2", "nodes"]


def test_covered_terms(spark):
    got = lambda term, text: one(spark, T.covered(F.col("t"), F.col("x"), F.col("k")), t=term, x=text, k=text.split())
    assert got("ros2", "uses ros 2 here") and not got("ros2", "uses dds") and got("nodes", "a node") and got("fixed-step", "fixedstep")


def test_snippet_units(spark):
    assert one(spark, T.snippet_units(F.col("t")), t="One two. Three four! 五。六") == ["One two.", "Three four!", "五。", "六"]
    assert [len(u) for u in one(spark, T.snippet_units(F.col("t")), t="x" * 500)] == [220, 220, 60]
    assert one(spark, T.snippet_units(F.col("t")), t="  ") == []


def test_uuid5(spark):
    assert one(spark, T.uuid5(F.col("t")), t="abc:0") == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc:0"))


def test_language_mix(spark):
    assert one(spark, T.chinese_ratio(F.col("t")), t="仿真ab") == 0.5
    assert one(spark, T.chinese_ratio(F.col("t")), t="12") == 0.0
    assert one(spark, T.mojibake(F.col("t")), t="cafÃ©") is False
    assert one(spark, T.mojibake(F.col("t")), t="æ ç") is True
