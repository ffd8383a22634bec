import pytest
from pyspark.sql import functions as F

from inkstream.functions import prompts
from inkstream.operators.generation import CannedModel, ExtractiveModel, HashingEncoder, IntentConfig, create_model, embed, generate_answers, register_model, rewrite_one, rewrite_queries, stream_answer


@pytest.mark.parametrize(
    "question,kind",
    [("谁和谁有什么区别", "factual"), ("A vs B", "comparison"), ("A VS B", "default"), ("什么是光", "concept"), ("光的未来", "open_discussion"), ("好吗？", "open_discussion"), ("好吗?", "open_discussion"), ("好", "default"), ("", "default")],
)
def test_classify(spark, question, kind):
    assert spark.createDataFrame([(question,)], "q string").select(prompts.classify_query(F.col("q"))).first()[0] == kind


@pytest.mark.parametrize(
    "sizes,kept",
    [([3000], [3000]), ([3001], [3003]), ([2799, 500], [2799, 204]), ([2800, 500], [2800]), ([1000, 1000, 1000, 5], [1000, 1000, 1000]), ([2900, 500, 50], [2900]), ([3000, 10, 10], [3000]), ([10, 20], [10, 20]), ([2500, 600, 600, 10], [2500, 503]), ([0, 3100], [0, 3003])],
)
def test_trim(spark, sizes, kept):
    rows = [("q", i + 1, f"s{i}", chr(97 + i) * n) for i, n in enumerate(sizes)]
    got = prompts.trim_context(spark.createDataFrame(rows, "qid string, rank int, source string, content string")).orderBy("rank").collect()
    assert [len(r["content"]) for r in got] == kept
    assert all(r["content"].rstrip(".") == chr(96 + r["rank"]) * len(r["content"].rstrip(".")) for r in got)


def test_prompt_keeps_braces_of_passages(spark):
    hits = spark.createDataFrame([("q", 1, None, "有{括号}的文"), ("q", 2, "书", "x" * 700)], "qid string, rank int, source string, content string")
    row = prompts.rag_prompts(spark.createDataFrame([("q", "谁？"), ("r", "好")], "qid string, text string"), hits).orderBy("qid").collect()
    assert row[0]["user_prompt"] == "参考资料:\n[1] 来源: 未知\n有{括号}的文\n\n[2] 来源: 书\n" + "x" * 600 + "\n\n用户问题: 谁？\n\n请根据以上参考资料回答问题："
    assert row[0]["system_prompt"].startswith("你是一个精确的") and row[1]["user_prompt"].startswith("参考资料:\n\n\n用户问题")


def test_templates():
    mine = prompts.TEMPLATES | {"mine": "{a}-{b}"}
    text = prompts.template_named("mine", mine)
    assert prompts.format_template(text, a="1", b="{a}", c="3") == "1-{a}"
    assert prompts.template_variables(text) == ["a", "b"] and "none" not in mine and "query_rewrite_basic" in mine
    for call in (lambda: prompts.template_named("none"), lambda: prompts.format_template(text, a="1"), lambda: prompts.rewrite_prompt(F.lit("q"), F.array(), F.lit(""), default="none")):
        with pytest.raises(ValueError):
            call()


def test_system_prompts(spark):
    mine = prompts.with_prompt(prompts.PROMPTS, "x", "p", "shot")
    types = spark.createDataFrame([("x",), ("none",), ("default",), (None,)], "t string")
    x, *others = (r[0] for r in types.select(prompts.system_prompt(F.col("t"), mine)).collect())
    assert x == "p\n\nshot" and set(others) == {prompts.PROMPTS["default"]} and "x" not in prompts.PROMPTS
    assert prompts.with_prompt({}, "y", "p") == {"y": "p"}
    assert "x" not in prompts.without_prompt(mine, "x") and "default" in prompts.without_prompt(mine, "default")


def test_rewrite_prompts(spark):
    rows = [(1, " 查询 ", ["a", "b"], "爱好"), (2, "q", ["a"], None), (3, "q", None, "p"), (4, "q", [], ""), (5, "  ", None, None), (6, None, None, None)]
    df = spark.createDataFrame(rows, "i int, query string, context array<string>, p string")
    got = [r[0] for r in df.orderBy("i").select(prompts.rewrite_prompt(F.col("query"), F.col("context"), F.col("p"))).collect()]
    t = lambda name, **values: prompts.format_template(prompts.TEMPLATES[name], **values)
    assert got[0] == t("query_rewrite_full", query="查询", context="a\nb", user_profile="爱好")
    assert got[1] == t("query_rewrite_context", query="q", context="a")
    assert got[2] == t("query_rewrite_personalized", query="q", user_profile="p")
    assert got[3] == t("query_rewrite_basic", query="q") and got[4:] == [None, None]
    only = df.where("i = 1").select(prompts.select_template(F.col("context"), F.col("p"), both=False)).first()[0]
    assert only == "query_rewrite_personalized"


def failing():
    class Failing:
        def generate(self, prompt):
            raise RuntimeError("down")

    return Failing()


def test_rewrite_falls_back(spark):
    df = spark.createDataFrame([("a",), (" ",)], "query string")
    prompt = prompts.rewrite_prompt(F.col("query"), F.array().cast("array<string>"), F.lit(""))
    assert [r["rewritten"] for r in rewrite_queries(df, prompt, CannedModel(" 重写结果 ")).collect()] == ["重写结果", " "]
    assert [r["rewritten"] for r in rewrite_queries(df, prompt, failing()).collect()] == ["a", " "]
    for query, model in (("", CannedModel("x")), ("q", failing())):
        with pytest.raises(ValueError):
            rewrite_one(model, query, "p")


def test_extractive_model(spark):
    hits = spark.createDataFrame([("q", 1, "甲", "天气很好。长城的长度是两万公里。再见。"), ("q", 2, "乙", "长城很长！苹果很甜。")], "qid string, rank int, source string, content string")
    asked = prompts.rag_prompts(spark.createDataFrame([("q", "长城的长度是多少？"), ("r", "无关问题")], "qid string, text string"), hits)
    got = {r["qid"]: r["answer"] for r in generate_answers(asked, ExtractiveModel()).collect()}
    assert got == {"q": "长城的长度是两万公里。 [来源: 甲]\n长城很长！ [来源: 乙]", "r": "未找到相关信息"}
    rows = spark.createDataFrame([("请问什么是 光合作用？",), ("谁",), ("  ",)], "query string")
    prompt = prompts.rewrite_prompt(F.col("query"), F.array().cast("array<string>"), F.lit(""))
    assert [r["rewritten"] for r in rewrite_queries(rows, prompt, ExtractiveModel()).collect()] == ["光合作用", "谁", "  "]


def test_answers(spark):
    df = spark.createDataFrame([("q", "default", "s", "u")], "qid string, query_type string, system_prompt string, user_prompt string")
    assert generate_answers(df, CannedModel("好")).first()["answer"] == "好"
    assert generate_answers(df, failing()).first()["error"] == "down"
    parts = list(stream_answer(CannedModel(), "q", "p", lambda p: iter("你好")))
    assert [p["answer"] for p in parts] == ["你", "你好", "你好"] and parts[-1]["finished"]


def test_models(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    for args in (("nobody",), ("openai",)):
        with pytest.raises(ValueError):
            create_model(*args)
    register_model("openai", lambda **k: CannedModel(k["model"]))
    assert create_model(" OpenAI ", api_key="k").generate("") == "gpt-3.5-turbo"
    monkeypatch.setenv("A_KEY", "secret")
    c = IntentConfig({"intent": {"api_client": {"api_key": "${A_KEY}"}}})
    assert c.api_client["api_key"] == "secret" and c.prompt_template == "query_rewrite_basic"


def test_embed(spark):
    got = [r[0] for r in spark.createDataFrame([("你好世界",), ("你好世界",), (None,)], "t string").select(embed(F.col("t"), HashingEncoder(16))).collect()]
    assert got[0] == got[1] and len(got[2]) == 16 and sum(x * x for x in got[0]) == pytest.approx(1)
