import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedra import samples as S
from sedra.operators import chunk, cite, evaluate, query, tables, tag
from sedra.plans import pipeline
from sedra.queries import QUERIES
from sedra.sources import files


def one(spark, column, **values):
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if isinstance(v, list) else T.StringType()) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def rewritten(spark, text):
    return one(spark, query.rewrite(F.col("t")), t=text)


def test_rewrite_is_one_pass(spark):
    assert rewritten(spark, "k mang bằng lái") == "không mang theo Giấy phép lái xe"
    assert rewritten(spark, "Xe máy bị CSGT giam xe") == "xe mô tô bị Cảnh sát giao thông tạm giữ phương tiện"
    assert rewritten(spark, "vượt đèn đỏ") == "; không chấp hành hiệu lệnh của đèn tín hiệu giao thông"
    assert rewritten(spark, "bấm điện thoại nghe điện thoại") == "sử dụng điện thoại di động"
    assert rewritten(spark, "xe máy điện") == "xe máy điện" and rewritten(spark, None) == ""


def test_deconstruct(spark):
    ask = lambda t: one(spark, query.deconstruct(F.col("t")), t=t)
    assert ask("xe máy vượt đèn đỏ và không đội mũ bảo hiểm") == ["xe mô tô vượt đèn đỏ", "không đội mũ bảo hiểm"]
    assert ask("ô tô và xe máy quá tốc độ")[-2:] == ["xe ô tô quá tốc độ", "xe mô tô quá tốc độ"]
    assert ask("xe đạp điện uống rượu") == ["xe đạp điện uống rượu"]
    assert ask("ngắn") == ["ngắn"] and ask("") == [] and ask(None) == []
    assert "1.5" in " ".join(ask("nồng độ cồn 1.5 mg"))


def test_route_and_history(spark):
    go = lambda t: one(spark, query.route(F.col("t")), t=t)
    assert go("phạt bao nhiêu") == "local" and go("gây tai nạn chết người") == "cloud" and go("a " * 31) == "cloud" and go("") == "local"
    m = spark.createDataFrame([([("user", f"q{i}") for i in range(6)] + [("assistant", "<thought>x</thought> " + "y" * 205)],)], "m array<struct<role:string,content:string>>")
    lines = m.select(query.history(F.col("m")).alias("h")).first().h.split("\n")
    assert len(lines) == 5 and lines[0] == "- Người dùng: q2" and lines[-1] == "- Trợ lý: " + "y" * 200 + "..."
    assert m.select(query.history(F.slice("m", 1, 2)).alias("h")).first().h == "- Người dùng: q0\n- Người dùng: q1"
    r = lambda a, b, c: one(spark, query.reformulated(F.col("o"), F.col("r"), F.lit(c)), o=a, r=b)
    assert r("cũ", '"Viết lại: mới"', True) == "mới" and r("cũ", "mới", False) == "cũ" and r("cũ", None, True) == "cũ"


DECREE = S.DECREES[0]


def test_chunker_rules():
    rows = chunk.parse(DECREE[2], DECREE[0], DECREE[1])
    assert [(r["chunk_id"], r["chunk_type"]) for r in rows] == [("ND1__Dieu_1", "dieu"), ("ND1__Dieu_2__Khoan_1", "khoan"), ("ND1__Dieu_2__Khoan_2", "khoan"), ("ND1__Dieu_3__Khoan_1", "khoan")]
    first = rows[1]
    assert first["full_citation"] == "Khoản 1 Điều 2 Nghị định 1/2020/NĐ-CP" and first["text"].count("\n") == 4 and "2. Phạt tiền từ 300.000" in first["text"]  # the back-reference swallows
    assert rows[2]["text"].endswith("4. Số này không liền mạch.") and (rows[2]["chuong"], rows[2]["muc"], rows[2]["muc_title"]) == ("II", "1", "ĐƯỜNG BỘ")
    whole = chunk.parse(DECREE[2], DECREE[0], DECREE[1], chunk.Options("dieu"))
    assert [r["chunk_id"] for r in whole] == ["ND1__Dieu_1", "ND1__Dieu_2", "ND1__Dieu_3"] and whole[1]["text"].startswith("1. Phạt tiền") and whole[1]["khoan"] is None
    points = chunk.parse(DECREE[2], DECREE[0], DECREE[1], chunk.Options("diem"))
    assert {r["chunk_type"] for r in points} == {"dieu", "khoan"} and [r["chunk_id"] for r in points].count("ND1__Dieu_2__Khoan_1") == 4 and all(r["diem"] is None for r in points)
    assert points[2]["full_citation"].startswith("Điểm a Khoản 1")
    split = chunk.parse(DECREE[2], DECREE[0], DECREE[1], chunk.Options(max_chunk_chars=80))
    assert [r["chunk_id"] for r in split[1:5]] == [f"ND1__Dieu_2__Khoan_1__{x}" for x in ("lead", "Diem_a", "Diem_b", "Diem_c")] and split[2]["text"].startswith(split[1]["text"] + "\na) ")
    heads = chunk.parse(DECREE[2], DECREE[0], DECREE[1], chunk.Options(emit_structural_headings=True))
    assert [r["chunk_id"] for r in heads if r["chunk_type"] in ("chuong", "muc")] == ["ND1__chuong_I", "ND1__chuong_II", "ND1__muc_1"]
    assert chunk.parse("Chương I " + "chữ " * 15 + "\nĐiều 1. Tên dài\nThân", "D", "D")[0]["chuong"] is None
    assert chunk.parse("Điều 1. Tên dài\nThân bài", "D", "D", chunk.Options(emit_dieu_when_no_khoan=False)) == [] and chunk.parse("", "D", "D") == []
    skip = chunk.parse("Điều 1. Tên dài\n1. Một:\na) x\nb) y\nđ) z", "D", "D")
    assert skip[0]["text"] == "Một:\na) x\nb) y\nđ) z" and skip[0]["diem"] is None
    with pytest.raises(ValueError):
        chunk.Options("other")


def test_csv_to_chunks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿chapter_number,chapter_title,article_number,article_title,content\nChương I,CHUNG,1,Phạm vi,"Đầu 1. Một: a) x b) y 2. Hai"\n,,2,Khác,"Dòng\nhai"\nChương I,CHUNG,3,Nữa,\n', encoding="utf-8")
    articles = files.read_articles(spark, str(tmp_path / "a.csv"), "Luật A", "LA")
    text = chunk.synthetic_documents(articles).first().text
    assert text == "Chương I. CHUNG\nĐiều 1. Phạm vi\nĐầu\n1. Một:\na) x\nb) y\n2. Hai\n\nĐiều 2. Khác\nDòng\nhai\n\nĐiều 3. Nữa\n"
    rows = chunk.chunk_documents(chunk.synthetic_documents(articles)).orderBy("seq").collect()
    assert [r.chunk_id for r in rows] == ["LA__Dieu_1", "LA__Dieu_1__Khoan_1", "LA__Dieu_1__Khoan_2", "LA__Dieu_2"]
    assert files.read_articles(spark, str(tmp_path / "a.csv"), "Luật A", "LA", only="XX").count() == 0


def test_pages(spark):
    page = "phương-\ntiện\n12\nCÔNG BÁO/Số 1\nTrang 3/10\n\n\n\nCuối "
    assert one(spark, chunk.clean_page(F.col("t")), t=page) == "phươngtiện\n\nCuối"


def test_tables_and_texts(spark):
    t = spark.createDataFrame([("T1", 3, S.TABLES[0][1], "Luật", "L"), ("T2", 1, [["x"]], "Luật", "L")], "table_id string, page_num int, rows array<array<string>>, source_doc string, doc_short string")
    r = tables.table_chunks(t).collect()
    assert len(r) == 1 and r[0].full_citation == "Bảng tại trang 3 - Luật" and r[0].chunk_id == "T1"
    assert r[0].linear_form.startswith("Hành vi: Vượt đèn đỏ. Mức phạt: 4-6 triệu. Bổ sung: Tước GPLX.") and r[0].metadata.row_count == 3
    c = tag.attach(spark.createDataFrame([("c", "Ô tô chạy quá tốc độ", "T", "khoan", None, "K 1")], "chunk_id string, text string, dieu_title string, chunk_type string, linear_form string, full_citation string"))
    got = c.select(tag.embed_text(with_citation=True).alias("e"), tag.rerank_text().alias("r"), tag.training_text().alias("t")).first()
    label = "Quy định này áp dụng cho lỗi chạy quá tốc độ quy định, vượt tốc độ giới hạn. Áp dụng cho người điều khiển xe ô tô, xe hơi."
    assert (got.e, got.r, got.t) == (f"K 1. T. Ô tô chạy quá tốc độ. {label}", f"T. {label}. Ô tô chạy quá tốc độ", "T. Ô tô chạy quá tốc độ")
    assert tag.corpus(c).count() == 1
    with pytest.raises(ValueError):
        tag.corpus(c.withColumn("text", F.lit(" ")).withColumn("dieu_title", F.lit(None).cast("string")).withColumn("metadata", F.lit(None).cast(c.schema["metadata"].dataType)))


def test_validation(spark):
    got = {r.answer_id: r for r in QUERIES["citation_validate"](spark, "").collect()}
    assert [i for i, r in got.items() if r.is_valid] and {i for i, r in got.items() if r.is_valid} == {1, 3, 5, 6, 8, 11}
    assert got[2].failures == ["unsupported citation"] and got[4].failures == ["no citation"] and got[10].failures == ["no citation"]
    assert got[7].failures == ["forbidden phrase"] and got[9].failures == ["vehicle mismatch"] and got[3].n_citations == 0


def test_answers(spark):
    got = {r.id: r for r in QUERIES["answer_judgement"](spark, "").collect()}
    assert (got[1].accuracy, got[1].rca, got[3].rca, got[4].rca, got[5].rca, got[2].rca, got[6].rca) == (1.0, "Context_Loss", "Context_Loss", "Retrieval_Drift", "Hallucination", "Hallucination", None)
    assert got[2].contradicts and not got[1].contradicts
    tags = one(spark, evaluate.expected_citations(F.col("t")), t="Điểm a Khoản 2 Điều 5 và điều 57 QCVN 41, luật Trật tự")
    assert set(tags) == {"dieu_5", "dieu_57", "khoan_2", "diem_a", "QCVN_41", "LUAT_TTATGT"}
    cases = spark.createDataFrame([(1, ["dieu_5", "khoan_9"]), (2, [])], "case int, tags array<string>")
    found = spark.createDataFrame([(1, "X__Dieu_57", "", "57", None, None), (1, "X__Dieu_5", "", None, None, None)], "case int, chunk_id string, text string, dieu string, khoan string, diem string")
    assert {r.case: r.coverage for r in evaluate.citation_coverage(cases, found).collect()} == {1: 0.5, 2: 1.0}
    assert evaluate.citation_coverage(cases, found.where("dieu = '57'")).where("case = 1").first().coverage == 0.0
    assert one(spark, evaluate.citation_drift(F.col("a"), F.col("t")), a="theo Điều 5", t=["Điều 5, Khoản 1"]) is False
    assert one(spark, evaluate.failure_mode(F.col("k"), F.col("e")), k="numeric_trap", e=["self_contradiction"]) == "numeric trap"


def test_pipeline_with_stub_models(spark):
    docs = spark.createDataFrame([DECREE], "source_doc string, doc_short string, text string")
    chunks = tag.attach(chunk.chunk_documents(docs))
    asked = spark.createDataFrame([(1, "xe ô tô không chấp hành tín hiệu đèn phạt bao nhiêu"), (2, "zzz qqq www vvv uuu"), (3, "ô tô dừng xe sai quy định và chạy quá tốc độ")], "query_id int, text string")
    say = lambda m: F.when(F.element_at(m, -1)["content"].rlike("(?s)Câu hỏi:.*tốc độ"), "Bịa (Điều 99).").otherwise("<thought>t</thought>Trả lời: Xe ô tô bị phạt (Khoản 1 Điều 2).")
    got = {r.query_id: r for r in pipeline.answer(asked, chunks, generator=say).collect()}
    assert len(got) == 3 and got[3].refused and got[3].failures == ["unsupported citation"] and len(got[3].intents) == 2
    assert got[1].answer == "Xe ô tô bị phạt (Khoản 1 Điều 2)." and got[1].thought == "t" and "ND1__Dieu_2__Khoan_1" in got[1].sources
    reply = lambda m: F.lit(json.dumps({"question": "hỏi ", "answer": "đáp"}))
    assert [(r.question, r.answer) for r in pipeline.distill(chunks, reply, 2).collect()] == [("hỏi", "đáp")] * 2
    assert pipeline.distill(chunks, lambda m: F.lit("no json"), 2).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("đ", None), ("b", ["x"])], "query string, extra_positive_ids array<string>")
    assert files.write_jsonl(df, str(tmp_path / "j")) == 2
    pairs = files.read_pairs(spark, str(tmp_path / "j")).orderBy("query").collect()
    assert [(r.query, r.extra_positive_ids, r.manual_negative_ids) for r in pairs] == [("b", ["x"], []), ("đ", [], [])]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "old"}\n\n{"chunk_id": "1", "text": "new"}\n{"text": "none"}\n')
    assert [(r.chunk_id, r.text) for r in files.read_chunks(spark, str(tmp_path / "c.jsonl"), "chunk_id string, id string, text string").collect()] == [("1", "new")]
    (tmp_path / "y.yaml").write_text("a: 1")
    assert files.read_yaml(str(tmp_path / "y.yaml")) == {"a": 1}
    (tmp_path / "d.pdf").write_bytes(b"p1|p2")
    pages = files.read_binary_pages(spark, str(tmp_path), lambda b: b.decode().split("|"))
    assert files.full_texts(pages).first().text == "p1\n\np2"
    t = files.read_tables(spark, str(tmp_path), lambda b: [(1, [["a"]]), (2, [["b"]]), (2, [["c"]])], "D").collect()
    assert [r.table_id for r in t] == ["D__page1__t1", "D__page2__t1", "D__page2__t2"]


def test_json_and_judges(spark):
    df = spark.createDataFrame([(1, ("100", "2019"), ["x"], None)], "id int, nghi_dinh struct<a:string,b:string>, xs array<string>, s string")
    assert files.from_json(files.as_json(df, "id"), "id int, nghi_dinh struct<a:string,b:string>, xs array<string>, s string").collect() == df.collect()
    cases = spark.createDataFrame([("q", "a", ["c"], "t")], "question string, answer string, contexts array<string>, ground_truth string")
    row = evaluate.judged(cases, lambda m, q, a, c, g: F.lit(len(m))).first()
    assert row.faithfulness == 12.0 and files.ragas_rows(cases).first().n_contexts == 1
    say = lambda x: lambda m: F.lit(x)
    q = spark.createDataFrame([("cloud",), ("local",)], "route string")
    out = lambda **k: [r.x for r in q.select(pipeline.routed(F.col("route"), say("near"), **k)(F.lit(None)).alias("x")).collect()]
    assert out() == ["near", "near"] and out(cloud=say("far")) == ["far", "near"] and out(cloud=say("far"), mode="cloud") == ["far", "far"]
    assert out(cloud=lambda m: F.lit(None).cast("string")) == ["near", "near"]


def test_matrix_of_several_arrays_in_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "a", "n": 1},\n {"id": "b"}]\n[{"id": "ć", "n": 2}]\n', encoding="utf-8")
    (tmp_path / "b.json").write_text('\ufeff[\n]\n[{"id": "d", "tags": ["x, ]["]}]', encoding="utf-8")
    got = sorted((r.id, r.n, r.tags) for r in evaluate.load_matrix(spark, str(tmp_path)).collect())
    assert got == [("a", 1, None), ("b", None, None), ("d", None, ["x, ]["]), ("ć", 2, None)]


def test_chunks_are_handed_on_in_small_batches(monkeypatch):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = ["Điều 1. Whole\n" + "\n".join(f"{i}. clause {i} of {d}" for i in range(1, 40)) for d in range(20)] + [None, "", "Điều 2. One\n1. " + "x" * 500]
    batch = pa.RecordBatch.from_pylist([{"source_doc": "S", "doc_short": f"D{d}", "text": t} for d, t in enumerate(texts)])
    run = chunk._chunker(chunk.Options(), to_arrow_schema(T.StructType.fromDDL(chunk.CHUNK_SCHEMA)))
    whole = [r for b in run([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(chunk, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(chunk, "CHARS_AT_ONCE", 60)
    got = [*run([batch, batch.slice(0, 0)])]
    assert max(b.num_rows for b in got) <= 7 and all(sum(b.column("char_count").to_pylist()[:-1]) < 60 for b in got)
    assert [r for b in got for r in b.to_pylist()] == whole
    assert whole == [r | {"seq": i} for d, t in enumerate(texts) for i, r in enumerate(chunk.parse(t, "S", f"D{d}"))] and len(whole) > 700
