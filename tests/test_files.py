import json

import pytest
from pyspark.sql import functions as F

from inkstream.operators import documents, eda
from inkstream.operators.generation import HashingEncoder
from inkstream.sources import files
from inkstream.streaming import incremental

XML = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title> 甲 </title><ns>0</ns><revision><text>{long}</text></revision></page>
<page><title>乙</title><ns>1</ns><revision><text>{long}</text></revision></page>
<page><title>丙</title><ns>0</ns><revision><text>#REDIRECT [[甲]]</text></revision></page>
<page><title>丁</title><ns>0</ns><revision><text>{{{{消歧义}}}}{long}</text></revision></page>
<page><title>戊</title><ns>0</ns><revision><text>short</text></revision></page>
<page><title>己</title><revision><text>'''{long}'''</text></revision></page>
</mediawiki>"""


def test_wiki_pages(spark, tmp_path):
    (tmp_path / "w.xml").write_text(XML.format(long="這個文字很長。" * 40), "utf-8")
    pages = files.read_wiki_pages(spark, str(tmp_path / "w.xml"))
    got = documents.wiki_articles(pages).orderBy("id").collect()
    assert [(r["id"], r["title"], r["length"]) for r in got] == [(0, "甲", 280), (1, "己", 280)]
    assert got[0]["text"].startswith("这个文字很長" if "長" not in documents.TRADITIONAL else "这个文字很长")
    assert {r["reason"]: r["n_pages"] for r in documents.skip_counts(pages).collect()} == {"kept": 2, "namespace": 1, "redirect": 1, "disambiguation": 1, "short": 1}
    assert documents.wiki_articles(pages, 1).count() == 1


def test_wiki_pages_of_several_files_are_in_file_order(spark, tmp_path):
    page = "<page><title>{}</title><ns>0</ns><revision><text>{}</text></revision></page>"
    for f, sizes in (("a", (300, 400)), ("b", (90_000,)), ("c", (500, 600))):
        (tmp_path / f"{f}.xml").write_text("<mediawiki>" + "".join(page.format(f"{f}{i}", "字" * n) for i, n in enumerate(sizes)) + "</mediawiki>", "utf-8")
    got = documents.wiki_articles(files.read_wiki_pages(spark, str(tmp_path))).orderBy("id").collect()
    assert [r["title"] for r in got] == ["a0", "a1", "b0", "c0", "c1"]


def test_tsv(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('qid\ttext\n1\ta "q\tb\n\n  \nbad\n2\t x \n', "utf-8")
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "q.tsv"), ("qid", "text")).collect()] == [("1", 'a "q\tb'), ("2", " x")]
    assert files.count_data_lines(spark, str(tmp_path / "q.tsv")) == 5 and files.count_data_lines(spark, str(tmp_path / "none")) == 0
    (tmp_path / "r.tsv").write_text("qid\tpid\trel\n1\t5\t2\n1\t5\t3\n2\t6\n", "utf-8")
    assert sorted(tuple(r) for r in files.read_qrels(spark, str(tmp_path / "r.tsv")).collect()) == [("1", "5"), ("2", "6")]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, '逗,号"引\n行'), (2, None)], "id long, text string")
    assert files.write_csv(df, str(tmp_path / "c")) and files.write_json(df, str(tmp_path / "j")) and files.write_parquet(df, str(tmp_path / "p"))
    for back in (files.read_csv(spark, str(tmp_path / "c"), "id long, text string"), files.read_json_lines(spark, str(tmp_path / "j"), "id long, text string"), files.read_parquet(spark, str(tmp_path / "p"))):
        assert sorted(map(tuple, back.collect())) == [(1, '逗,号"引\n行'), (2, None)]
    (tmp_path / "o.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert files.read_json(spark, str(tmp_path / "o.json")).count() == 2
    (tmp_path / "t.txt").write_bytes("好".encode() + b"\xff" + b"x\n")
    assert files.read_text(spark, str(tmp_path / "t.txt")).first()["content"] == "好x\n"
    assert [r["name"] for r in files.list_files(spark, str(tmp_path), ".txt").collect()] == ["t.txt"] and files.list_files(spark, str(tmp_path / "none")).count() == 0
    assert files.preview(spark, str(tmp_path / "t.txt"), width=1).count() == 1
    assert files.write_text(spark.createDataFrame([("a",)], "value string"), str(tmp_path / "x"))
    (tmp_path / "a.jsonl").write_text('{"title":"t","text":"x"}\n', "utf-8")
    assert files.read_documents(spark, str(tmp_path / "a.jsonl")).first()["metadata"]["article_id"] == ""


def test_incremental_build_resumes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("1", "<b>足够长的一段文字内容</b>"), ("2", "短"), ("3", None)], "pid string, text string")
    rows.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        incremental.build_index(spark, source, target, "pid string, text string", HashingEncoder(8))
    assert [(r["id"], r["document"]) for r in incremental.read_index(spark, target).collect()] == [("1", "足够长的一段文字内容")]
    rows.withColumn("pid", F.concat("pid", F.lit("x"))).coalesce(1).write.mode("append").parquet(source)
    incremental.build_index(spark, source, target, "pid string, text string", HashingEncoder(8))
    assert incremental.read_index(spark, target).count() == 2
    log = {(r["batch"], r["outcome"]): r["n"] for r in incremental.build_log(spark, target).collect()}
    assert log == {(b, o): 1 for b in (0, 1) for o in ("stored", "short", "null")}
    assert incremental.index_info(spark, target).first()["batches"] == 2


def test_build_in_parts_and_anew(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "pid string, text string"
    spark.createDataFrame([(str(i), "足够长的一段文字内容" if i % 4 else "短") for i in range(40)], schema).repartition(4).write.parquet(source)
    build = lambda **o: incremental.build_index(spark, source, target, schema, files_per_batch=1, **o)
    build(max_batches=1)
    first = incremental.read_index(spark, target).count()
    assert 0 < first < 30 and incremental.index_info(spark, target).first()["batches"] == 1
    build(max_batches=2)
    build()
    assert incremental.read_index(spark, target).select("id").distinct().count() == incremental.read_index(spark, target).count() == 30
    assert {r["outcome"]: r["n"] for r in incremental.outcomes(spark.read.parquet(source)).collect()} == {"stored": 30, "short": 10}
    build(rebuild=True, max_batches=1)
    assert incremental.index_info(spark, target).first()["batches"] == 1
    assert incremental.build_or_load(spark, source, target, schema).count() == incremental.read_index(spark, target).count()
    assert incremental.build_or_load(spark, source, target + "2", schema).count() == 30


def test_paths_with_a_scheme_and_errors(spark, tmp_path):
    url = f"file://{tmp_path}"
    (tmp_path / "a.tsv").write_text("h\th\n1\tx\n", "utf-8")
    assert [r["name"] for r in files.list_files(spark, url).collect()] == ["a.tsv"] and files.list_files(spark, url + "/none").count() == 0
    assert files.count_data_lines(spark, url + "/a.tsv") == 1 and files.count_data_lines(spark, url + "/none") == 0
    with pytest.raises(Exception, match=".+"):
        files.write_parquet(spark.createDataFrame([(1,)], "a int"), "nosuchscheme://x/y")
    (tmp_path / "c.csv").write_text('a,b\n1,"x ""y"""\n', "utf-8")
    assert [tuple(r) for r in files.read_csv(spark, url + "/c.csv", "a int, b string", multi_line=False).collect()] == [(1, 'x "y"')]


def test_rewrite_in_place_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "這")], "id int, text string").write.parquet(path)
    for _ in range(2):
        got = files.rewrite_parquet(spark, path, lambda rows: documents.simplified_update(rows.withColumns({"title": F.lit("t"), "length": F.lit(1)})).select("id", "text"))
    assert got.first()["text"] == "这" and spark.read.parquet(path + ".bak").first()["text"] == "这"
    with pytest.raises(ZeroDivisionError):
        files.rewrite_parquet(spark, path, lambda rows: rows.limit(1 // 0))
    assert spark.read.parquet(path).count() == 1


def test_documents_and_figures(spark):
    df = spark.createDataFrame([("<b>Hello, World Text</b>",), ("hello, world text",), ("x",), (None,)], "content string")
    assert [r["content"] for r in documents.process_documents(df).collect()] == ["hello, world text"]
    assert documents.process_documents(df.withColumnRenamed("content", "other")).count() == 4
    log = spark.createDataFrame([("a", "u", 1), ("a", "u", None), ("b", "v", 2), (None, None, 1)], "Query string, AnonID string, ClickPos int")
    assert tuple(eda.query_distribution(log).first()) == (2, 1, 1, 0, 0)
    assert [tuple(r) for r in eda.most_common(log, "ClickPos").collect()] == [(1, 2), (2, 1)]
    report = json.loads(eda.report(df, log).first()["report"])
    assert report["basic_stats"]["total_records"] == 4 and set(report) == {"basic_stats", "document_length", "query_distribution", "user_behavior", "click_behavior"}
    n = spark.createDataFrame([(x,) for x in (5, 1, 3, 2)], "n int")
    assert tuple(eda.at_indexes(n, "n", {"m": (1, 2), "q": (3, 4)}).first()) == (3, 5)
    assert [r["id"] for r in documents.numbered(n, "n").orderBy("n").collect()] == [0, 1, 2, 3]
    assert eda.collection_stats(df.withColumnRenamed("content", "text").limit(0)).first()["total"] == 0
