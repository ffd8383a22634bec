"""Query types, prompts and their parts as column expressions; a registry of templates."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.text import strip

# Query types with their key words, in the order in which they are tried.
QUERY_TYPES = {
    "factual": ["什么时候", "多少", "谁", "哪里", "哪一年", "日期", "年龄", "多高", "多长"],
    "comparison": ["区别", "对比", "不同", "差异", " vs ", "比较", "哪个更好", "优缺点"],
    "concept": ["什么是", "定义", "概念", "解释", "什么意思", "原理"],
    "open_discussion": ["发展趋势", "影响", "未来", "前景", "历程", "历史", "发展"],
}

# The system prompts by query type, and the examples of two of them.
SYSTEM_PROMPTS = {
    "default": "你是一个基于知识库回答问题的助手。请根据以下检索到的维基百科资料来回答问题。\n如果资料不足以回答问题，请如实说明，不要编造信息。\n回答时请注明引用的资料来源（文档标题）。",
    "factual": "你是一个精确的知识问答引擎。请根据以下检索资料，给出简洁准确的事实性回答。\n要求：\n1. 先给出直接答案（一句话）\n2. 再提供 2-3 句补充说明\n3. 在相关句子末尾用 [来源: 文档标题] 注明出处\n4. 如果资料中没有确切答案，直接说「未找到相关信息」，不要猜测",
    "concept": "你是一个概念解释专家。请根据以下检索资料，对一个概念进行清晰的定义和解释。\n要求：\n1. 先给出核心定义（1-2 句）\n2. 再展开关键要点（用 bullet points）\n3. 每个要点后标注 [来源: 文档标题]\n4. 如果信息不足，注明哪些内容是资料覆盖的，哪些是推理补充的",
    "open_discussion": "你是一个知识综合与评述专家。请根据以下检索资料，对一个开放性问题给出综合性的分析和评述。\n要求：\n1. 先给出总体概述（2-3 句）\n2. 然后分 2-4 个角度展开讨论，每个角度冠以小标题\n3. 每个角度中引用相关资料并注明 [来源: 文档标题]\n4. 最后给出简要总结或展望",
    "comparison": "你是一个对比分析专家。请根据以下检索资料，对两个或多个事物进行系统地对比分析。\n要求：\n1. 先简要介绍各方的基本情况（各1句）\n2. 用表格形式列出核心对比维度（维度 | 甲方 | 乙方）\n3. 表格中每个数据点注明 [来源: 文档标题]\n4. 最后总结各方适用场景或优劣",
}
FEW_SHOT = {
    "factual": "\n示例问答：\n参考资料:\n[1] 来源: 阿尔伯特·爱因斯坦\n阿尔伯特·爱因斯坦（1879年3月14日—1955年4月18日），德国出生的理论物理学家...\n\n用户问题: 爱因斯坦什么时候出生？\n\n回答:\n爱因斯坦出生于1879年3月14日 [来源: 阿尔伯特·爱因斯坦]。他是公认的二十世纪最伟大的物理学家之一，提出了狭义相对论和广义相对论。\n\n---\n",
    "concept": "\n示例问答：\n参考资料:\n[1] 来源: 光合作用\n光合作用是植物、藻类和某些细菌利用叶绿素将光能转化为化学能的过程...\n\n用户问题: 什么是光合作用？\n\n回答:\n光合作用是植物等生物利用光能将二氧化碳和水转化为有机物并释放氧气的过程 [来源: 光合作用]。\n\n关键要点：\n- 需要光能和叶绿素参与 [来源: 光合作用]\n- 反应方程式：6CO₂ + 6H₂O → C₆H₁₂O₆ + 6O₂ [来源: 光合作用]\n- 是地球上最重要的化学反应之一，维持大气氧含量\n\n---\n",
}
# Fixed value: the user prompt.
USER_TEMPLATE = "参考资料:\n{context}\n\n用户问题: {question}\n\n请根据以上参考资料回答问题："

# The templates for rewriting queries.
REWRITE_TEMPLATES = {
    "query_rewrite_basic": "请将以下用户查询改写成更明确、更适合搜索的关键词：\n用户查询：{query}\n重写后的搜索词：",
    "query_rewrite_enhanced": "你是一个搜索助手。请将用户的自然语言查询转换为精准的搜索关键词。\n要求：\n1. 提取核心概念\n2. 使用简洁的短语\n3. 保留关键实体\n\n用户查询：{query}\n搜索关键词：",
    "query_rewrite_expanded": "请将用户查询进行扩展和优化，使其更适合搜索引擎检索：\n用户查询：{query}\n优化后的查询：",
    "query_rewrite_context": "基于对话历史，将当前查询重写为独立搜索词：\n\n对话历史：{context}\n当前查询：{query}\n\n重写后的搜索词：",
    "query_rewrite_personalized": "根据用户偏好，将查询重写为更精准的搜索词：\n\n用户偏好：{user_profile}\n查询：{query}\n\n重写后的搜索词：",
}


def filled(template: str, **values: Column) -> Column:
    """The template with columns in the places of its variables; what the columns hold is never read as a template."""
    return F.concat(*[values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p])


def classify_query(question: Column) -> Column:
    out = None
    for name, words in QUERY_TYPES.items():
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | question.contains(w)
        out = F.when(any_word, name) if out is None else out.when(any_word, name)
    return out.when(question.endswith("？") | question.endswith("?"), "open_discussion").otherwise("default")


#: The prompts by query type as they are sent: ``with_prompt`` and ``without_prompt`` make other such mappings.
PROMPTS = {name: f"{prompt}\n\n{FEW_SHOT.get(name, '')}" for name, prompt in SYSTEM_PROMPTS.items()}


def with_prompt(prompts: Mapping[str, str], name: str, *parts: str) -> dict[str, str]:
    """``prompts`` and one more, of a prompt and perhaps examples, which a blank line separates."""
    return {**prompts, name: "\n\n".join(p for p in parts if p)}


def without_prompt(prompts: Mapping[str, str], name: str) -> dict[str, str]:
    """``prompts`` without one; the default stays, since every type without a prompt of its own gets it."""
    return {k: v for k, v in prompts.items() if k != name or k == "default"}


def system_prompt(query_type: Column, prompts: Mapping[str, str] = PROMPTS) -> Column:
    """The prompt of each type, looked up in a map literal."""
    pairs = [F.lit(x) for pair in prompts.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), query_type), F.lit(prompts["default"]))


def trim_context(hits: DataFrame, limit: int = 3000, least: int = 200) -> DataFrame:
    """Each query's hits ``(qid, rank, content, ...)`` up to ``limit`` characters.

    The first hit that doesn't fit is cut to what is left, with dots, if that is more than ``least``; later ones go.
    """
    upto = F.sum(F.length("content")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    left = F.lit(limit) - (F.col("_upto") - F.length("content"))
    rows = hits.withColumn("_upto", upto)
    first_over = (F.col("_upto") > limit) & (left >= 0)
    cut = F.when(F.col("_upto") <= limit, F.col("content")).when(first_over & (left > least), F.concat(F.substring("content", F.lit(1), left.cast("int")), F.lit("...")))
    # an earlier overflow that left exactly nothing ends the list too
    overs = F.sum((F.col("_upto") > limit).cast("int")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_overs", overs).withColumn("content", cut).where("content is not null and _overs <= 1").drop("_upto", "_overs")


def in_order(value: Column, rank: str = "rank") -> Column:
    """Values of a group by rank."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v")))), lambda s: s["v"])


def format_context(hits: DataFrame, longest: int = 600) -> DataFrame:
    """``(qid, context)`` of hits ``(qid, rank, source, content)``: numbered sources with the beginning of their text."""
    number = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    entry = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] 来源: "), F.coalesce("source", F.lit("未知")), F.lit("\n"), F.substring("content", 1, longest))
    return hits.withColumn("_i", number).groupBy("qid").agg(F.array_join(in_order(entry), "\n\n").alias("context"))


def passages_markdown(hits: DataFrame, longest: int = 300) -> DataFrame:
    """``(qid, passages)`` of hits ``(qid, rank, pid, content)`` for display."""
    number = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    entry = F.concat(F.lit("**["), F.col("_i").cast("string"), F.lit("] pid="), F.coalesce("pid", F.lit("?")), F.lit("**\n> "), F.replace(F.substring("content", 1, longest), F.lit("\n"), F.lit(" ")), F.lit("...\n\n"))
    return hits.withColumn("_i", number).groupBy("qid").agg(F.array_join(in_order(entry), "").alias("passages"))


def rag_prompts(questions: DataFrame, hits: DataFrame, prompts: Mapping[str, str] = PROMPTS, limit: int = 3000) -> DataFrame:
    """``(qid, query_type, system_prompt, user_prompt)`` of ``questions (qid, text)`` with their hits; a question without hits has an empty context."""
    context = format_context(trim_context(hits, limit))
    rows = questions.select("qid", "text").join(context, "qid", "left").withColumn("query_type", classify_query(F.col("text")))
    user = filled(USER_TEMPLATE, context=F.coalesce("context", F.lit("")), question=F.col("text"))
    return rows.select("qid", "query_type", system_prompt(F.col("query_type"), prompts).alias("system_prompt"), user.alias("user_prompt"))


#: The rewriting templates by name; a mapping with more or others can be given wherever they are used. Both context and profile count when both are there.
TEMPLATES = REWRITE_TEMPLATES | {"query_rewrite_full": "基于对话历史和用户偏好，将查询重写为更精准的独立搜索词：\n\n对话历史：{context}\n用户偏好：{user_profile}\n当前查询：{query}\n\n重写后的搜索词："}


def template_variables(template: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", template)


def template_named(name: str, templates: Mapping[str, str] = TEMPLATES) -> str:
    """ValueError for an unknown name."""
    if name not in templates:
        raise ValueError(f"no template {name!r}; there are {list(templates)}")
    return templates[name]


def format_template(template: str, **values: str) -> str:
    """The template with its variables' values, which are never read as templates; others are ignored, a missing one is a ValueError."""
    if missing := [v for v in template_variables(template) if v not in values]:
        raise ValueError(f"the template needs {missing}")
    return re.sub(r"\{(\w+)\}", lambda m: values[m[1]], template)


def select_template(context: Column, profile: Column, default: str = "query_rewrite_basic", both: bool = True) -> Column:
    """Which template fits; without the one for ``both``, the profile's is taken."""
    has_context, has_profile = F.coalesce(F.size(context) > 0, F.lit(False)), F.coalesce(profile != "", F.lit(False))
    full = "query_rewrite_full" if both else "query_rewrite_personalized"
    return F.when(has_context & has_profile, full).when(has_context, "query_rewrite_context").when(has_profile, "query_rewrite_personalized").otherwise(default)


def rewrite_prompt(query: Column, context: Column, profile: Column, templates: Mapping[str, str] = TEMPLATES, default: str = "query_rewrite_basic") -> Column:
    """The prompt that asks for a rewritten query; null for a blank query. ``default``, which must be one of ``templates``, is for queries without context and profile."""
    template_named(default, templates)
    name = select_template(context, profile, default, "query_rewrite_full" in templates)
    values = {"query": strip(query), "context": F.array_join(context, "\n"), "user_profile": profile}
    usable = [F.when(name == key, filled(text, **values)) for key, text in templates.items() if set(template_variables(text)) <= set(values)]
    return F.when(F.coalesce(strip(query), F.lit("")) != "", F.coalesce(*usable))
