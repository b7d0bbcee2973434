from __future__ import annotations

import json

from tessera.functions.strictjson import BAD, gold_array, loads
from tessera.operators.nested import LEVELS, ShapeAutomaton, nested_tables, subtype_table, supertype_keys, variant_counts


def paths(kind, text):
    """Keys in the order of a walk, parents first."""
    auto = ShapeAutomaton()
    return sorted(key for _, _, key, _ in auto.routed(auto.run(kind, text)))


def test_levels_and_wrappings():
    obs = {"秒": 1.0, "内容": "x", "候选": {"文本": "t", "得分": 0.5}}
    issue = {"问题类型": "其他", "证据": [{"工具": "a", "观测": json.dumps([obs, 3, obs])}, None, {"tool": "b", "observations": obs}]}
    want = [(1,), (1, 1), (1, 1, 1), (1, 1, 1, 1), (1, 1, 2), (1, 1, 2, 1), (1, 2), (1, 2, 1), (1, 2, 1, 1)]
    for text in (json.dumps([7, issue]), json.dumps(issue), json.dumps({"issues": [issue]}), json.dumps(json.dumps([issue])), f"```JSON\n{json.dumps([issue])}\n```"):
        assert paths("prediction", text) == want
    wrapped = {"issue": {"问题类型": "其他"}, "provenance": {"source": "A", "evidence": {"tool": "x"}}}
    assert paths("prediction", json.dumps([wrapped, issue]))[:3] == [(1,), (1, 1), (2,)]


def test_unusable():
    for text in (None, "", " ", "无", "[{]", '[{"a": NaN}]', "[1]", "{'a': 1}", "// x\n[{}]", '[{"a":1},]', "[" * 200000):
        assert paths("prediction", text) == []
    assert loads("[" * 200000) is BAD
    assert paths("prediction", "{}") == [(1,)]


def test_gold_last_valid_block():
    assert gold_array("t\n```json\n[{}]\n```\n```json\n[1]\n```") == [{}]
    assert gold_array("```json\n[{}]\n```\n```\r\n[]\n```") == []
    assert gold_array("[{}]") is None and gold_array(None) is None and gold_array("```json\n{}\n```") is None


def test_tables(spark):
    issue = {"问题类型": "其他", "证据": [{"工具": "a", "状态": "ok"}]}
    rows = [(1, json.dumps([issue]), "x"), (1, json.dumps([issue]), "x"), (2, None, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "pred_id bigint, prediction string, level string")
    assert sorted(map(tuple, supertype_keys(nested_tables(df, "prediction", "pred_id", "prediction", False)).collect())) == [("prediction", 1, 1, 0, 0, 0), ("prediction", 1, 1, 1, 0, 0)]
    flat = nested_tables(df.limit(1), "prediction", "pred_id", "prediction")
    (e,) = subtype_table(flat, "evidence").collect()
    assert (e.tool, e.status, e.parent.issue_pos, e.parent.evidence_pos) == ("a", "ok", 1, 0)
    assert nested_tables(df.limit(0), "prediction", "pred_id", "prediction").collect() == []


def test_states_decide():
    """Objects come out because of the states, and each state has its table."""
    auto = ShapeAutomaton()
    issue = {"问题类型": "其他", "证据": [{"工具": "a", "观测": [{"秒": 1}]}]}
    trees = auto.run("prediction", json.dumps([issue, {"issue": issue}, {"issue": {"issue_type": "x"}, "provenance": {"evidence": {"tool": "t"}}}]))
    assert [auto.name[t.state] for t in trees] == ["issue(issue_type:str,evidence:list)", "wrapped:issue(issue_type:str,evidence:list)", "beside:issue(issue_type:str,evidence:null)"]
    assert {auto.route[q] for _, q, _, _ in auto.routed(trees)} == set(LEVELS) - {"alt"}
    auto.holds = [0] * len(auto.holds)
    assert auto.run("prediction", json.dumps([issue])) == []


def test_any_depth_and_odd_values(spark):
    text = "[{}]"
    for _ in range(9):
        text = json.dumps(text)
    assert paths("prediction", text) == [(1,)]
    deep = "[" * 60_000 + "]" * 60_000
    assert paths("prediction", f'[{{"bbox": {deep}}}, {{}}]') == [(1,), (2,)]
    assert loads(f'{{"a": {deep}, "b": [1, {{"c": "d"}}]}}')["b"] == [1, {"c": "d"}]
    for bad in (deep + "]", deep[:-1], deep.replace("[]", "[1,]"), deep.replace("[]", '{"a" 1}'), deep.replace("[]", "[1 2]"), deep.replace("[]", "{1: 2}"), deep.replace("[]", "[:]")):
        assert loads(bad) is BAD
    cell = '[{"description": "\\ud800x", "issue_type": 12345678901234567890, "bbox": ' + "9" * 5000 + "}]"
    df = spark.createDataFrame([(1, cell), (2, f'[{{"bbox": {deep}}}]')], "pred_id bigint, prediction string")
    a, b = subtype_table(nested_tables(df, "prediction", "pred_id", "prediction"), "issue").orderBy("record_id").collect()
    assert (a.description, a.issue_type, a.bbox, b.bbox) == ("\ufffdx", "12345678901234567890", "9" * 5000, None)
    assert sorted(r.variant for r in variant_counts(nested_tables(df, "prediction", "pred_id", "prediction")).collect()) == ["issue(bbox:list,evidence:null)", "issue(description:str,issue_type:num,bbox:num,evidence:null)"]
