"""Queries of the law rules, prompts and answer checks over whole tables, and the same in SQL.

No table holds Vietnamese law, so each row of documents stands for a chunk, question or answer that is put together from fixed phrases by
the row's id. The SQL puts the same texts together and restates the rules on them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cite, dense, evaluate, filters, prompt, query, rerank, tag
from .plans import lexicon as L
from . import samples as S
from .queries import docs_of, register, rewrite_slang, table

VEHICLE_WORDS = ["xe ô tô", "Xe Máy", "xe đạp điện", "người đi bộ", "máy kéo", "xe khách", "xe thô sơ", "xe ô tô tải", "đoàn người", "xe máy chuyên dùng"]
ACTS = [
    "chạy quá tốc độ", "uống rượu, bia", "vượt đèn đỏ", "không đội mũ bảo hiểm", "đi sai làn", "dừng xe, đỗ xe trái phép", "lùi xe", "quay đầu xe", "chở quá số người", "quá tải",
    "dùng tay cầm điện thoại", "không có bằng", "biển số mờ", "hết hạn đăng kiểm", "đi chậm",
]
ENDINGS = [
    "", "; tước quyền sử dụng Giấy phép lái xe từ 01 tháng đến 03 tháng", "; tạm giữ phương tiện 07 ngày", "; TỊCH THU phương tiện", "; buộc khôi phục lại tình trạng ban đầu",
    "; buộc tháo dỡ, tạm giữ  phương tiện", ". Không áp dụng",
]
LABELS_V, LABELS_A = list(L.VEHICLES) + ["la"], list(L.VIOLATIONS) + ["khac"]


def _pick(values: list[str], n: str = "doc_id"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(f"({n}) % {len(values)}") + 1).cast("int"))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick_sql(values: list[str], n: str = "doc_id") -> str:
    return f"{_list_sql(values)}[CAST(({n}) % {len(values)} + 1 AS BIGINT)]"


def _case(table_: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table_.items()) + " END"


def chunks(spark, sf_dir):
    """A chunk for each document: text, title, levels, labels."""
    amount = lambda factor: F.format_number(F.expr(f"(doc_id % 997 + 1) * {factor}"), 0)
    dotted = lambda factor: F.replace(amount(factor), F.lit(","), F.lit("."))
    fine = F.when(F.expr("doc_id % 4 <> 3"), F.concat(F.lit("Phạt tiền từ "), dotted(1000), F.lit(" đồng đến "), dotted(2000), F.lit(" đồng đối với "))).otherwise(F.lit("Cấm "))
    text = F.concat(fine, _pick(VEHICLE_WORDS), F.lit(" "), _pick(ACTS, "doc_id div 3"), _pick(ENDINGS, "doc_id div 7"), F.lit("."))
    level = lambda n, m: F.when(F.expr(f"doc_id % {m} <> 0"), F.expr(f"doc_id % {n} + 1").cast("string"))
    labels = lambda names, k: F.when(F.expr(f"doc_id % {k} = 0"), F.lit(None).cast("array<string>")).when(F.expr(f"doc_id % {k} = 1"), F.array(_pick(names), _pick(names, "doc_id div 2"))).otherwise(F.array(_pick(names)))
    return docs_of(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("chunk_id"), _pick(["ND100", "ND123", "QCVN41", "TT38", ""], "doc_id div 5").alias("doc_short"), F.col("source").alias("source_doc"),
        level(90, 11).alias("dieu"), level(9, 3).alias("khoan"), F.when(F.expr("doc_id % 4 = 1"), _pick(["a", "b", "đ"])).alias("diem"),
        F.when(F.expr("doc_id % 3 <> 0"), F.concat(F.lit("Xử phạt "), _pick(VEHICLE_WORDS, "doc_id div 4"))).when(F.expr("doc_id % 6 = 0"), F.lit("")).alias("dieu_title"), text.alias("text"),
        F.when(F.expr("doc_id % 5 = 0"), F.lit("table")).otherwise("khoan").alias("chunk_type"), F.when(F.expr("doc_id % 10 = 0"), F.lit("Hàng: một.")).when(F.expr("doc_id % 10 = 5"), F.lit("")).alias("linear_form"),
        F.concat(F.lit("Điều "), F.expr("doc_id % 90 + 1").cast("string"), F.lit(" "), F.col("source")).alias("full_citation"),
        F.struct(labels(LABELS_V, 7).alias("vehicle_type"), labels(LABELS_A, 5).alias("violation_type"), F.expr("doc_id * 1000").alias("fine_min")).alias("metadata"),
    )


_DOTTED = lambda factor: f"replace(format('{{:,}}', CAST((doc_id % 997 + 1) * {factor} AS BIGINT)), ',', '.')"
_LABELS = lambda names, k: f"CASE WHEN doc_id % {k} = 0 THEN NULL WHEN doc_id % {k} = 1 THEN [{_pick_sql(names)}, {_pick_sql(names, 'doc_id // 2')}] ELSE [{_pick_sql(names)}] END"
CHUNKS_SQL = f"""chunks AS (SELECT doc_id, 'C' || doc_id AS chunk_id, {_pick_sql(["ND100", "ND123", "QCVN41", "TT38", ""], "doc_id // 5")} AS doc_short, source AS source_doc,
  CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 90 + 1 AS VARCHAR) END AS dieu, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 9 + 1 AS VARCHAR) END AS khoan, CASE WHEN doc_id % 4 = 1 THEN {_pick_sql(["a", "b", "đ"])} END AS diem,
  CASE WHEN doc_id % 3 <> 0 THEN 'Xử phạt ' || {_pick_sql(VEHICLE_WORDS, "doc_id // 4")} WHEN doc_id % 6 = 0 THEN '' END AS dieu_title,
  CASE WHEN doc_id % 4 <> 3 THEN 'Phạt tiền từ ' || {_DOTTED(1000)} || ' đồng đến ' || {_DOTTED(2000)} || ' đồng đối với ' ELSE 'Cấm ' END || {_pick_sql(VEHICLE_WORDS)} || ' ' || {_pick_sql(ACTS, "doc_id // 3")} || {_pick_sql(ENDINGS, "doc_id // 7")} || '.' AS text,
  CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'khoan' END AS chunk_type, CASE WHEN doc_id % 10 = 0 THEN 'Hàng: một.' WHEN doc_id % 10 = 5 THEN '' END AS linear_form,
  'Điều ' || (doc_id % 90 + 1) || ' ' || source AS full_citation, {_LABELS(LABELS_V, 7)} AS vehicle_type, {_LABELS(LABELS_A, 5)} AS violation_type, doc_id * 1000 AS fine_min FROM documents)"""

_B, _A = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"


def _tags(taxonomy: dict[str, str], text: str, whole: bool = True) -> str:
    parts = []
    for label, pattern in taxonomy.items():
        test = f"regexp_matches({text}, '(?i){_B}(?:{pattern.replace(chr(92) + 'b', _A)}){_A}')" if whole else f"regexp_matches({text}, '(?i){pattern}')"
        parts.append(f"CASE WHEN {test} THEN '{label}' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


_FINE = L.FINE
_JOINED_TEXT = "coalesce(dieu_title, '') || chr(10) || text"


@register(
    "chunk_metadata",
    f"""WITH {CHUNKS_SQL}, t AS (SELECT doc_id, {_JOINED_TEXT} AS t FROM chunks) SELECT doc_id, {_tags(L.VEHICLES, 't')} AS vehicle_type, {_tags(L.VIOLATIONS, 't')} AS violation_type, {_tags(L.SANCTIONS, 't', False)} AS sanctions,
    TRY_CAST(regexp_replace(regexp_extract(t, '(?i){_FINE}', 1), '\\D', '', 'g') AS BIGINT) AS fine_min, TRY_CAST(regexp_replace(regexp_extract(t, '(?i){_FINE}', 2), '\\D', '', 'g') AS BIGINT) AS fine_max FROM t""",
)
def chunk_metadata(spark, sf_dir):
    """Labels, fines and sanctions attached to every chunk from its title and text."""
    m = tag.attach(chunks(spark, sf_dir).drop("metadata"))
    join = lambda c: F.array_join(f"metadata.{c}", ",").alias(c)
    return m.select("doc_id", join("vehicle_type"), join("violation_type"), join("sanctions"), "metadata.fine_min", "metadata.fine_max")


def _phrase(table_: dict[str, str], column: str) -> str:
    return f"array_to_string(list_filter(list_transform(coalesce({column}, []), lambda x: {_case(table_, 'x')}), lambda x: x IS NOT NULL), ', ')"


_TEXTS_CTE = f"""{CHUNKS_SQL}, p AS (SELECT *, {_phrase(L.VIOLATION_PHRASES, 'violation_type')} AS va, {_phrase(L.VEHICLE_PHRASES, 'vehicle_type')} AS ve,
  CASE WHEN chunk_type = 'table' AND coalesce(linear_form, '') <> '' THEN linear_form ELSE text END AS body FROM chunks),
texts AS (SELECT *, nullif(concat_ws(' ', CASE WHEN va <> '' THEN 'Quy định này áp dụng cho lỗi ' || va || '.' END, CASE WHEN ve <> '' THEN 'Áp dụng cho người điều khiển ' || ve || '.' END), '') AS lex, nullif(dieu_title, '') AS title FROM p)"""


@register("index_texts", f"WITH {_TEXTS_CTE} SELECT doc_id, concat_ws('. ', title, body, lex) AS embed_text, concat_ws('. ', full_citation, title, lex, body) AS rerank_text, concat_ws('. ', title, body) AS training_text FROM texts")
def index_texts(spark, sf_dir):
    """The three texts of a chunk: indexed, reranked, trained on."""
    return chunks(spark, sf_dir).select("doc_id", tag.embed_text().alias("embed_text"), tag.rerank_text(with_citation=True).alias("rerank_text"), tag.training_text().alias("training_text"))


@register("index_corpus", f"WITH {_TEXTS_CTE} SELECT chunk_id, concat_ws('. ', title, body, lex) AS embed_text FROM texts UNION ALL SELECT 'T' || chunk_id, concat_ws('. ', title, text, lex) FROM texts WHERE doc_id % 5 <> 0")
def index_corpus(spark, sf_dir):
    """The corpus loader: chunks, then tables whose columns are fewer."""
    every = chunks(spark, sf_dir)
    tables_ = every.where("doc_id % 5 <> 0").select(F.concat(F.lit("T"), "chunk_id").alias("chunk_id"), "doc_id", "dieu_title", "text", "chunk_type", "metadata")
    return tag.corpus(every, tables_).select("chunk_id", "embed_text")


@register("index_fields", f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_short, source_doc, chunk_type, dieu, khoan, diem, dieu_title, full_citation, vehicle_type, violation_type, fine_min FROM chunks")
def index_fields(spark, sf_dir):
    """The columns that carry over to an index."""
    return filters.index_metadata(chunks(spark, sf_dir))


_TAG_SQL = f"""coalesce('[' || nullif(concat_ws(', ', 'Điểm ' || nullif(diem, ''), 'Khoản ' || nullif(khoan, ''), 'Điều ' || nullif(dieu, ''), nullif(coalesce({_case(L.DOCUMENT_NAMES, 'doc_short')}, doc_short), '')), '') || ']', '[Không rõ nguồn]')"""


@register("citation_tags", f"WITH {CHUNKS_SQL} SELECT doc_id, lower(diem) AS diem, {_TAG_SQL} AS tag FROM chunks")
def citation_tags(spark, sf_dir):
    upper = chunks(spark, sf_dir).withColumn("diem", F.upper("diem"))
    return cite.chunk_citation(upper).select("doc_id", "diem", cite.tag_of().alias("tag"))


_NAMES = f"concat_ws(' | ', 'Đối tượng áp dụng: ' || nullif({_phrase(L.VEHICLE_NAMES, 'vehicle_type')}, ''), 'Hành vi vi phạm: ' || nullif({_phrase(L.VIOLATION_NAMES, 'violation_type')}, ''))"
_PROMPT_SQL = f"""WITH {_TEXTS_CTE}, blocks AS (SELECT doc_id // 3 AS query, doc_id % 3 + 1 AS position, concat_ws(chr(10), '[Đoạn ' || (doc_id % 3 + 1) || '] ' || {_TAG_SQL}, title, nullif({_NAMES}, ''), body) AS block FROM texts),
ctx AS (SELECT query, string_agg(block, chr(10) || chr(10) ORDER BY position) AS context FROM blocks GROUP BY query)
SELECT query, 'system' AS first_role, len(context) AS context_chars, '<context>' || chr(10) || context || chr(10) || '</context>' || chr(10) || chr(10) || 'Câu hỏi: Hỏi ' || query || chr(10) || CASE WHEN query % 2 = 0 THEN '(Từ khóa pháp lý liên quan: ' || {_pick_sql(ACTS, 'query')} || ')' ELSE '' END || chr(10) || chr(10) || '{prompt.ASK}' AS user_message FROM ctx"""


@register("prompt_messages", _PROMPT_SQL)
def prompt_messages(spark, sf_dir):
    """Three chunks in the context of each question, and the messages around them."""
    sources = chunks(spark, sf_dir).withColumn("query", F.expr("doc_id div 3")).withColumn("position", F.expr("doc_id % 3 + 1"))
    ctx = prompt.contexts(sources)
    intents = F.when(F.expr("query % 2 = 0"), F.array(F.concat(F.lit("; "), _pick(ACTS, "query")), F.lit(" ; "))).otherwise(F.array().cast("array<string>"))
    said = prompt.messages(F.concat(F.lit(" Hỏi "), F.col("query").cast("string")), F.col("context"), intents)
    return ctx.select("query", said[0]["role"].alias("first_role"), F.length("context").cast("long").alias("context_chars"), said[1]["content"].alias("user_message"))


@register("training_messages", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Hãy đáp.' ELSE '{prompt.SYSTEM.replace(chr(39), chr(39) * 2)}' END AS system, '<context>' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END || chr(10) || '</context>' || chr(10) || chr(10) || 'Câu hỏi: Nguồn?' || chr(10) || chr(10) || '{prompt.ASK}' AS "user", source AS assistant FROM documents""")
def training_messages(spark, sf_dir):
    """Fine-tuning rows: system, user and assistant message of every example."""
    rows = docs_of(spark, sf_dir).select(
        F.when(F.expr("doc_id % 3 = 1"), F.lit("Hãy đáp.")).when(F.expr("doc_id % 3 = 2"), F.lit("")).alias("system"), F.when(F.expr("doc_id % 4 <> 0"), F.concat(F.lit(" "), "lang")).alias("context"),
        F.lit(" Nguồn? ").alias("question"), F.concat("source", F.lit("\n"), F.lit("#"), F.col("doc_id").cast("string")).alias("answer"),
    )
    m = F.col("messages")
    said = prompt.training_rows(rows).select(m[0]["content"].alias("system"), m[1]["content"].alias("user"), F.split(m[2]["content"], "\n#").alias("a"))
    return said.select(F.col("a")[1].cast("long").alias("doc_id"), "system", "user", F.col("a")[0].alias("assistant"))


@register("ranking_rows", "SELECT 'q' || (doc_id // 4) AS query, max(CASE WHEN doc_id % 4 = 0 THEN lang || doc_id END) AS positive, array_to_string(list(lang || doc_id ORDER BY doc_id DESC) FILTER (WHERE doc_id % 4 > 0), ',') AS negatives FROM documents GROUP BY doc_id // 4 HAVING count(*) > 1 AND max(CASE WHEN doc_id % 4 = 0 THEN 1 END) = 1")
def ranking_rows(spark, sf_dir):
    """Listwise examples: one positive and its mined negatives, by their texts."""
    docs = docs_of(spark, sf_dir)
    texts = docs.select(F.col("doc_id").alias("doc"), F.concat("lang", F.col("doc_id").cast("string")).alias("text"))
    mined = docs.where("doc_id % 4 > 0").select(F.expr("doc_id div 4").alias("pair"), F.concat(F.lit("q"), F.expr("doc_id div 4").cast("string")).alias("query"), F.expr("doc_id - doc_id % 4").alias("positive"), F.col("doc_id").alias("neg"), (-F.col("doc_id")).alias("place"))
    return prompt.ranking_rows(mined, texts).withColumn("negatives", F.array_join("negatives", ","))


# --- numbers, citations, answers -------------------------------------------------------------------------

_AMOUNT_SQL = """CASE doc_id % 5 WHEN 0 THEN doc_id || ' triệu' WHEN 1 THEN doc_id || ',' || (doc_id % 9 + 1) || ' triệu và ' || (doc_id % 900) || ' nghìn' WHEN 2 THEN doc_id || '.' || (doc_id % 90 + 10) || ' triệu' WHEN 3 THEN (doc_id % 999) || ' ngàn đồng' ELSE 'không có' END"""


@register(
    "number_words",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id * 1000000 AS VARCHAR) WHEN 1 THEN (doc_id * 1000000 + (doc_id % 9 + 1) * 100000) || ' và ' || (doc_id % 900) * 1000 WHEN 2 THEN CAST(doc_id * 1000000 + (doc_id % 90 + 10) * 10000 AS VARCHAR)
    WHEN 3 THEN (doc_id % 999) * 1000 || ' đồng' ELSE 'không có' END AS plain FROM documents""",
)
def number_words(spark, sf_dir):
    """Spelled amounts as digits; the SQL reckons them from the row's number."""
    n = lambda e: F.expr(e).cast("string")
    text = (
        F.when(F.expr("doc_id % 5 = 0"), F.concat(n("doc_id"), F.lit(" triệu"))).when(F.expr("doc_id % 5 = 1"), F.concat(n("doc_id"), F.lit(","), n("doc_id % 9 + 1"), F.lit(" triệu và "), n("doc_id % 900"), F.lit(" nghìn")))
        .when(F.expr("doc_id % 5 = 2"), F.concat(n("doc_id"), F.lit("."), n("doc_id % 90 + 10"), F.lit(" triệu"))).when(F.expr("doc_id % 5 = 3"), F.concat(n("doc_id % 999"), F.lit(" ngàn đồng"))).otherwise("không có")
    )
    return docs_of(spark, sf_dir).select("doc_id", evaluate.spelled_numbers(text).alias("plain"))


EXPECTATIONS = ["Phạt 4.000.000 đồng theo Điều 6, Khoản 5, điểm Đ", "Theo QCVN 41 và Luật Trật tự an toàn, điều 9", "Không phạt", "10.600.000 hoặc 600.000; Khoản 2 Khoản 2 Điều 12", "TTATGT: 1.000 và 12.34, Điều 6"]
_ALL = lambda what, p, t: f"list_transform(regexp_extract_all({t}, '(?i){what}\\s+({p})', 1), lambda x: '{{0}}_' || lower(x))"


@register(
    "expected_tags",
    f"""WITH e AS (SELECT doc_id, {_pick_sql(EXPECTATIONS)} || ' ' || doc_id AS t FROM documents),
    tags AS (SELECT doc_id, t, list_concat({_ALL('Điều', '[0-9]+', 't').format('dieu')}, {_ALL('Khoản', '[0-9]+', 't').format('khoan')}, {_ALL('Điểm', '[a-zđ]', 't').format('diem')},
      CASE WHEN contains(t, 'QCVN 41') THEN ['QCVN_41'] ELSE [] END, CASE WHEN contains(t, 'TTATGT') OR contains(lower(t), 'trật tự') THEN ['LUAT_TTATGT'] ELSE [] END) AS g FROM e)
    SELECT doc_id, array_to_string(list_sort(list_distinct(g)), ',') AS tags, array_to_string(list_filter(string_split_regex(t, '[^0-9.]+'), lambda x: regexp_full_match(x, '[0-9]{{1,3}}([.][0-9]{{3}})+')), ',') AS fines FROM tags""",
)
def expected_tags(spark, sf_dir):
    """The amounts and citation tags that a test case expects."""
    t = F.concat(_pick(EXPECTATIONS), F.lit(" "), F.col("doc_id").cast("string"))
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(F.sort_array(evaluate.expected_citations(t)), ",").alias("tags"), F.array_join(evaluate.expected_fines(t), ",").alias("fines"))


_COVER_SQL = f"""WITH {CHUNKS_SQL}, cases AS (SELECT doc_id // 4 AS "case", 'dieu_' || (doc_id // 4 % 90 + 1) AS a, 'khoan_' || (doc_id // 4 % 9 + 1) AS b, doc_id // 4 % 3 AS k FROM chunks GROUP BY doc_id // 4),
want AS (SELECT "case", unnest(CASE k WHEN 0 THEN [a, b] WHEN 1 THEN [a] ELSE [] END) AS tag FROM cases),
got AS (SELECT DISTINCT w."case", w.tag FROM want w JOIN chunks c ON c.doc_id // 4 = w."case" WHERE 'dieu_' || coalesce(c.dieu, '') = w.tag OR 'khoan_' || coalesce(c.khoan, '') = w.tag)
SELECT "case", CASE WHEN k = 2 THEN 1.0::DOUBLE ELSE coalesce(n, 0)::DOUBLE / CASE k WHEN 0 THEN 2 ELSE 1 END END AS coverage FROM cases LEFT JOIN (SELECT "case", count(*) AS n FROM got GROUP BY "case") USING ("case")"""


def _cases(spark, sf_dir):
    case = F.expr("doc_id div 4")
    a, b = F.concat(F.lit("dieu_"), F.expr("case % 90 + 1").cast("string")), F.concat(F.lit("khoan_"), F.expr("case % 9 + 1").cast("string"))
    return docs_of(spark, sf_dir).select(case.alias("case")).distinct().select("case", F.when(F.expr("case % 3 = 0"), F.array(a, b)).when(F.expr("case % 3 = 1"), F.array(a)).otherwise(F.array().cast("array<string>")).alias("tags"))


@register("tag_coverage", _COVER_SQL)
def tag_coverage(spark, sf_dir):
    """The share of a case's expected tags that its retrieved chunks carry."""
    found = chunks(spark, sf_dir).select(F.expr("doc_id div 4").alias("case"), F.lit("x").alias("chunk_id"), "text", "dieu", "khoan", "diem")
    return evaluate.citation_coverage(_cases(spark, sf_dir), found)


REPLIES = ["Phạt 4.000.000 đồng.", "Không bị phạt, nhưng mức phạt là 6 triệu.", "Tôi không tìm thấy quy định.", "Bị phạt tiền 400 nghìn và 9.999.000 đồng", "Điều 6: 400.000 đồng"]
WANTED = [["4.000.000"], ["6.000.000", "mức phạt"], ["Tôi không tìm thấy"], ["400.000"], ["điều 6", "đỏ"], []]
CONTEXTS = ["4.000.000 và 6.000.000, mức phạt", "ĐIỀU 6, đỏ, 400.000", ""]
_ANSWER_SQL = f"""WITH r AS (SELECT doc_id, {_pick_sql(REPLIES)} AS a, [{", ".join(_list_sql(w) + "::VARCHAR[]" for w in WANTED)}][CAST(doc_id // 5 % {len(WANTED)} + 1 AS BIGINT)] AS e, {_pick_sql(CONTEXTS, "doc_id // 30")} AS c FROM documents),
m AS (SELECT *, list_filter(e, lambda w: NOT contains(lower(a), lower(w))) AS missing, list_filter(string_split_regex(a, '[^0-9.]+'), lambda x: regexp_full_match(x, '[0-9]{{1,3}}([.][0-9]{{3}})+')) AS amounts,
  list_filter(e, lambda x: regexp_full_match(x, '[0-9]{{1,3}}([.][0-9]{{3}})+')) AS due,
  regexp_replace(regexp_replace(regexp_replace(a, '6 triệu', '6000000'), '400 nghìn', '400000'), '[.,]', '', 'g') AS plain FROM r),
n AS (SELECT *, list_filter(list_distinct(amounts), lambda x: NOT list_contains(due, x)) AS invented, contains(lower(a), 'tôi không tìm thấy') AS refused FROM m)
SELECT doc_id, array_to_string(missing, ',') AS missing, array_to_string(invented, ',') AS invented,
  (contains(lower(a), 'không bị phạt') OR contains(lower(a), 'không vi phạm')) AND (contains(lower(a), 'mức phạt là') OR contains(lower(a), 'bị phạt tiền') OR contains(lower(a), 'phạt tiền từ')) AS contradicts,
  len(list_filter(e, lambda t: NOT contains(lower(a), trim(split_part(lower(t), ',', 1))))) > 0 AS drifts,
  CASE WHEN len(list_filter(due, lambda x: NOT list_contains(string_split_regex(plain, '[^0-9]+'), replace(x, '.', '')))) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS accuracy,
  CASE WHEN len(invented) > 0 AND NOT refused THEN 'Hallucination' WHEN len(missing) = 0 THEN NULL WHEN contains(lower(coalesce(e[1], '')), 'tôi không tìm thấy') THEN 'Hallucination'
    WHEN len(list_filter(missing, lambda w: NOT contains(lower(c), lower(w)))) > 0 THEN 'Retrieval_Drift' ELSE 'Context_Loss' END AS rca FROM n"""


def _answers(spark, sf_dir):
    wanted = F.array(*[F.array(*[F.lit(x) for x in w]).cast("array<string>") for w in WANTED])
    return docs_of(spark, sf_dir).select("doc_id", _pick(REPLIES).alias("a"), F.element_at(wanted, F.expr(f"cast(doc_id div 5 % {len(WANTED)} + 1 as int)")).alias("e"), _pick(CONTEXTS, "doc_id div 30").alias("c"))


@register("answer_checks", _ANSWER_SQL)
def answer_checks(spark, sf_dir):
    """What an answer lacks, invents, contradicts and drifts from; its calculation accuracy and the cause of its failure."""
    a, e = F.col("a"), F.col("e")
    return _answers(spark, sf_dir).select(
        "doc_id", F.array_join(evaluate.missing(a, e), ",").alias("missing"), F.array_join(evaluate.invented_amounts(a, e), ",").alias("invented"), evaluate.self_contradiction(a).alias("contradicts"),
        evaluate.citation_drift(a, e).alias("drifts"), evaluate.calculation_accuracy(a, F.flatten(F.transform(e, evaluate.expected_fines))).alias("accuracy"), evaluate.root_cause(a, e, F.col("c")).alias("rca"),
    )


@register("root_cause_counts", f"SELECT coalesce(rca, 'none') AS rca, count(*) AS n FROM ({_ANSWER_SQL}) GROUP BY ALL")
def root_cause_counts(spark, sf_dir):
    causes = _answers(spark, sf_dir).select(F.coalesce(evaluate.root_cause(F.col("a"), F.col("e"), F.col("c")), F.lit("none")).alias("rca"))
    return evaluate.count_by(causes, "rca")


KINDS, ERRORS = ["vehicle_bias", "multi_turn", "exception_clause", "numeric_trap", "other"], ["missing_entities", "citation_drift", "self_contradiction"]


@register(
    "failure_modes",
    f"""WITH t AS (SELECT doc_id, {_pick_sql(KINDS)} AS kind, {_pick_sql(ERRORS, "doc_id // 5")} AS err FROM documents)
    SELECT doc_id, CASE WHEN kind = 'vehicle_bias' AND err = 'missing_entities' THEN 'query deconstruction' WHEN kind = 'multi_turn' AND err IN ('missing_entities', 'citation_drift') THEN 'query reformulation'
    WHEN kind = 'exception_clause' AND err = 'self_contradiction' THEN 'prompt and context' WHEN kind = 'numeric_trap' AND err IN ('self_contradiction', 'citation_drift') THEN 'numeric trap' ELSE 'unclassified' END AS mode FROM t""",
)
def failure_modes(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", evaluate.failure_mode(_pick(KINDS), F.array(_pick(ERRORS, "doc_id div 5"))).alias("mode"))


@register(
    "suite_rollup",
    """SELECT count(*) AS n_cases, round(avg(coalesce(CASE WHEN doc_id % 7 > 0 THEN (doc_id % 4) / 4.0::DOUBLE END, 0)), 9) AS coverage, round(avg((doc_id % 2)::DOUBLE), 9) AS accuracy,
    round(avg(coalesce(CASE WHEN doc_id % 7 > 0 THEN (doc_id % 5) / 5.0::DOUBLE END, 0)), 9) AS hallucination_rate, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS passed FROM documents""",
)
def suite_rollup(spark, sf_dir):
    """Means over all cases; a failed case's nulls count as 0."""
    ok = F.expr("doc_id % 7 > 0")
    cases = docs_of(spark, sf_dir).select(
        F.when(ok, F.expr("doc_id % 4") / 4.0).alias("coverage"), F.expr("doc_id % 2").cast("double").alias("accuracy"), F.when(ok, F.expr("doc_id % 5") / 5.0).alias("hallucination_rate"), F.expr("doc_id % 3 = 0").alias("passed")
    )
    out = evaluate.suite(cases)
    return out.select("n_cases", *[F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "hallucination_rate", "passed")])


# --- citations of answers --------------------------------------------------------------------------------

GIVEN = ["Phạt (Điểm a, Khoản 5, Điều 5 Nghị định 100/2019/NĐ-CP).", "Theo [Khoản 9 Điều 99] và (Khoản 5 Điều 5).", "Không rõ.", "Xem (QCVN 41:2019) và (Điều 6)."]


@register(
    "citation_rates",
    f"""WITH a AS (SELECT doc_id AS answer_id, doc_id % 4 AS k, CAST(doc_id // 4 % 2 AS INTEGER) AS ev FROM documents),
    c AS (SELECT answer_id, ev, unnest(CASE k WHEN 0 THEN ['5/5/a'] WHEN 1 THEN ['99/9', '5/5'] WHEN 2 THEN [] ELSE ['q', '6'] END) AS c FROM a),
    s AS (SELECT answer_id, CASE c WHEN '5/5/a' THEN ev = 0 WHEN '99/9' THEN false WHEN '5/5' THEN ev = 0 WHEN 'q' THEN ev = 1 ELSE ev = 1 END AS ok FROM c)
    SELECT answer_id, round(sum(CASE WHEN ok THEN 0.0::DOUBLE ELSE 1 END) / count(*), 9) AS rate FROM s GROUP BY answer_id""",
)
def citation_rates(spark, sf_dir):
    """Unsupported over all citations of every answer that cites; half the answers have one evidence, half another."""
    docs = docs_of(spark, sf_dir)
    answers = docs.select(F.col("doc_id").alias("answer_id"), _pick(GIVEN).alias("answer"))
    one = lambda doc, dieu, khoan, diem: F.struct(F.lit(doc).alias("doc_short"), F.lit(dieu).cast("string").alias("dieu"), F.lit(khoan).cast("string").alias("khoan"), F.lit(diem).cast("string").alias("diem"))
    rows = F.when(F.expr("doc_id div 4 % 2 = 0"), F.array(one("ND100", "5", "5", None))).otherwise(F.array(one("QCVN41", None, None, None), one("ND123", "6", "1", None)))
    evidence = docs.select(F.col("doc_id").alias("answer_id"), F.inline(rows))
    return cite.hallucination_rate(cite.supported(cite.cited(answers), evidence)).withColumn("rate", F.round("rate", 9))


# --- questions -------------------------------------------------------------------------------------------

WORDS = ["Xe máy", "vượt đèn đỏ", "k mang bằng lái", "nghe điện thoại", "bấm điện thoại", "chở ba", "đường 1 chiều", "say rượu", "bb", "đậu xe trên vỉa hè", "con wave", "CSGT", "không đội nón bảo hiểm", "đi"]


def _question():
    return F.concat(_pick(WORDS), F.lit(" "), _pick(WORDS, "doc_id div 14"), F.lit("  "), _pick(WORDS, "doc_id div 5"), F.lit("?"))


_QUESTION_SQL = f"{_pick_sql(WORDS)} || ' ' || {_pick_sql(WORDS, 'doc_id // 14')} || '  ' || {_pick_sql(WORDS, 'doc_id // 5')} || '?'"
_W = r"[^\p{L}\p{M}\p{N}_]"
#: Words between chr(2) and chr(1), so that neighbouring phrases do not share the sign that bounds them.
_MARKED = lambda t: f"chr(2) || regexp_replace({t}, '({_W}+)', chr(1) || '\\1' || chr(2), 'g') || chr(1)"
_BARE = lambda t: f"replace(replace({t}, chr(1), ''), chr(2), '')"
_KEYS = sorted(L.SYNONYMS, key=len, reverse=True)
_PATTERN = "(?i)\\x02(?:" + "|".join(k.replace(" ", "\\x01 \\x02") for k in _KEYS) + ")\\x01"
_FORMAL_CTE = f"""
k AS (SELECT doc_id, {_BARE(f"regexp_replace({_MARKED('t')}, '(?i)' || chr(2) || 'k' || chr(1), 'không', 'g')")} AS t FROM q),
m AS (SELECT doc_id, {_MARKED('trim(t)')} AS t FROM k),
z AS (SELECT doc_id, string_split_regex(t, '{_PATTERN}') AS gaps, list_transform(regexp_extract_all(t, '{_PATTERN}'), lambda x: {_case({k.lower(): v for k, v in L.SYNONYMS.items()}, "lower(" + _BARE('x') + ")")}) AS puts FROM m),
j AS (SELECT doc_id, {_BARE("array_to_string(list_transform(list_zip(gaps, puts), lambda p: p[1] || coalesce(p[2], '')), '')")} AS t FROM z),
p AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(t, '(?:sử dụng điện thoại di động\\s*)+', 'sử dụng điện thoại di động ', 'g')), '(?:điện thoại di động\\s*)+', 'điện thoại di động ', 'g')) AS t FROM j),
formal AS (SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS formal FROM p)"""
_REWRITE_SQL = f"WITH q AS (SELECT doc_id, {_QUESTION_SQL} AS t FROM documents), {_FORMAL_CTE} SELECT doc_id, formal FROM formal"
_SLANG_SQL = f"WITH q AS (SELECT doc_id, coalesce(t, '') AS t FROM {S.values(S.QUESTIONS, 'doc_id', 't')}), {_FORMAL_CTE} SELECT doc_id AS query_id, formal AS rewritten FROM formal"
register("rewrite_slang", _SLANG_SQL)(rewrite_slang)


@register("rewrite_questions", _REWRITE_SQL)
def rewrite_questions(spark, sf_dir):
    """Colloquial phrases as formal terms, over as many questions as there are documents."""
    return docs_of(spark, sf_dir).select("doc_id", query.rewrite(_question()).alias("formal"))


MODEL_REPLIES = ["\"Câu hỏi viết lại: Xe máy?\"", "viết lại:  Ô tô", "'Đi bộ'", "", "Chỉ vậy"]
CLEAN_REPLIES = ["Xe máy?", "Ô tô", "Đi bộ", None, "Chỉ vậy"]


@register("reformulated", "SELECT conv_id, turn, CASE WHEN turn > 0 THEN coalesce([" + ", ".join("NULL" if c is None else f"'{c}'" for c in CLEAN_REPLIES) + "][CAST((conv_id + turn) % 5 + 1 AS BIGINT)], text) ELSE text END AS question FROM conversations")
def reformulated(spark, sf_dir):
    """A model's stand-alone question where there is a history and it said something."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", query.reformulated(F.col("text"), _pick(MODEL_REPLIES, "conv_id + turn"), F.col("turn") > 0).alias("question"))


LAW_TEXTS = ["đi xe máy", "Ô TÔ và xe đạp", "xe máy chuyên dùng", "mô-tô", "đi bộ", "xe thô sơ, máy kéo", "không", "đixe máy"]


@register("vehicles_mentioned", f"WITH t AS (SELECT doc_id, {_pick_sql(LAW_TEXTS)} AS t FROM documents) SELECT doc_id, {_tags(tag.MENTIONED, 't')} AS vehicles FROM t")
def vehicles_mentioned(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(tag.vehicles_mentioned(_pick(LAW_TEXTS)), ",").alias("vehicles"))


# --- vectors, reranking without a model ------------------------------------------------------------------


@register("distance_similarity", "SELECT vec_id, round(1.0 - embedding[1]::DOUBLE, 9) AS cosine, round(-(embedding[2]::DOUBLE), 9) + 0.0 AS l2 FROM embeddings")
def distance_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = lambda i: F.col("embedding")[i].cast("double")
    return e.select("vec_id", F.round(dense.similarity("cosine", x(0)), 9).alias("cosine"), (F.round(dense.similarity("l2", x(1)), 9) + F.lit(0.0)).alias("l2"))


@register("rerank_pass_through", "SELECT doc_id // 10 AS query, doc_id AS doc, 0.0::DOUBLE AS cross_encoder_score, CAST(10 - doc_id % 10 AS INTEGER) AS pre_rerank_rank, CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id DESC) AS INTEGER) AS rank FROM documents QUALIFY rank <= 3")
def rerank_pass_through(spark, sf_dir):
    """Without a model the order that came in stays."""
    c = docs_of(spark, sf_dir).select(F.expr("doc_id div 10").alias("query"), F.col("doc_id").alias("doc"), F.expr("cast(10 - doc_id % 10 as int)").alias("rank"))
    return rerank.rerank(c, None, 3).select("query", "doc", "cross_encoder_score", "pre_rerank_rank", "rank")


# --- whole answers ---------------------------------------------------------------------------------------


@register(
    "rag_answers",
    """SELECT item_id AS query_id, item_id % 4 > 0 AS refused, item_id % 4 = 0 AS reply_valid, array_to_string(CASE item_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['unsupported citation'] WHEN 2 THEN ['no citation'] ELSE ['forbidden phrase'] END, ',') AS failures,
    CASE item_id % 4 WHEN 0 THEN 'Phạt (Điều 1).' ELSE 'refusal' END AS answer, 'nghĩ' AS thought FROM benchmark""",
)
def rag_answers(spark, sf_dir):
    """All benchmark items asked and answered; a stand-in model cites rightly, cites what is not there, does not cite, or says what is forbidden."""
    from .plans import pipeline
    from .queries import rag_chunks

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("q"), F.col("item_id").cast("string"), F.lit(" asks about: "), "text").alias("text"))
    said = F.array(*[F.lit(x) for x in ("Phạt (Điều 1).", "Phạt (Khoản 9 Điều 999).", "Phạt nặng.", "Theo tôi thì phạt (Điều 1).")])
    number = lambda m: F.regexp_extract(m[1]["content"], r"Câu hỏi: q(\d+) ", 1).cast("int")
    model = lambda m: F.concat(F.lit("<thought>nghĩ</thought>\nTrả lời: "), F.element_at(said, number(m) % 4 + 1))
    out = pipeline.answer(asked, rag_chunks(spark, sf_dir), generator=model)
    refusal = pipeline.Settings().refusal
    return out.select("query_id", "refused", "reply_valid", F.array_join("failures", ",").alias("failures"), F.when(F.col("answer") == refusal, "refusal").otherwise(F.col("answer")).alias("answer"), "thought")


# --- questions taken apart, routed; answers validated ----------------------------------------------------

ASKERS = ["Xe máy", "Ô tô", "Xe đạp", "Ô tô và xe máy", "Tôi"]
OFFENCES = ["vượt đèn đỏ", "không đội mũ bảo hiểm", "uống rượu", "quá tốc độ", "đánh võng"]
_PARTS_SQL = f"""WITH q AS (SELECT doc_id, {_pick_sql(ASKERS)} AS v, {_pick_sql(OFFENCES, 'doc_id // 5')} AS a, {_pick_sql(OFFENCES, 'doc_id // 25')} AS b FROM documents),
m AS (SELECT *, v IN ('Xe máy', 'Ô tô và xe máy') OR contains(a || b, 'mũ bảo hiểm') AS moto, v IN ('Ô tô', 'Ô tô và xe máy') AS auto, v = 'Xe đạp' AS other FROM q),
p AS (SELECT *, unnest([a, b || '?']) AS part, unnest([0, 1]) AS i FROM m),
e AS (SELECT doc_id, i, CASE WHEN other AND NOT contains(part, 'mũ bảo hiểm') THEN ['xe đạp ' || part] WHEN other THEN [part] WHEN contains(part, 'mũ bảo hiểm') THEN [part] WHEN moto AND auto THEN ['xe ô tô ' || part, 'xe mô tô ' || part]
  WHEN moto THEN ['xe mô tô ' || part] WHEN auto THEN ['xe ô tô ' || part] ELSE [part] END AS qs FROM p)
SELECT doc_id, array_to_string(flatten(list(qs ORDER BY i)), '|') AS questions FROM e GROUP BY doc_id"""


@register("deconstruct_questions", _PARTS_SQL)
def deconstruct_questions(spark, sf_dir):
    """The atomic questions in compound ones, each about the vehicles that the whole names."""
    text = F.concat(_pick(ASKERS), F.lit(" "), _pick(OFFENCES, "doc_id div 5"), F.lit(" và "), _pick(OFFENCES, "doc_id div 25"), F.lit("?"))
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(query.deconstruct(text), "|").alias("questions"))


CALLS = ["Phạt thế nào", "Gây TAI NẠN rồi bỏ chạy", "Xe cứu thương đi ngược", "Có đúng không", "Đi chậm"]


@register("route_questions", f"WITH q AS (SELECT doc_id, {_pick_sql(CALLS)} || repeat(' từ', CAST(doc_id % 37 AS INTEGER)) AS t FROM documents) SELECT doc_id, CASE WHEN len(string_split(t, ' ')) > 30 OR regexp_matches(lower(t), '{'|'.join(L.ROUTE_ALWAYS + L.ROUTE_COMPLEX)}') THEN 'cloud' ELSE 'local' END AS route FROM q")
def route_questions(spark, sf_dir):
    """Long or grave questions go to the large model."""
    text = F.concat(_pick(CALLS), F.repeat(F.lit(" từ"), F.expr("cast(doc_id % 37 as int)")))
    return docs_of(spark, sf_dir).select("doc_id", query.route(text).alias("route"))


STATED = ["Tôi không tìm thấy quy định phù hợp nào.", "Xe ô tô bị phạt (Khoản 5 Điều 5).", "Phạt (Khoản 5 Điều 5) và (Điều 99).", "Bạn đi đúng luật.", "Phạt nặng.", "Theo tôi, phạt (Điều 6)."]
_VALID_SQL = f"""WITH a AS (SELECT doc_id AS answer_id, doc_id % 6 AS k, doc_id // 6 % 2 AS ev, doc_id // 12 % 2 AS moto FROM documents),
c AS (SELECT *, CASE k WHEN 1 THEN ['5/5'] WHEN 2 THEN ['5/5', '99'] WHEN 5 THEN ['6'] ELSE [] END AS cites FROM a),
s AS (SELECT *, len(list_filter(cites, lambda x: (x = '5/5' AND ev = 0) OR (x = '6' AND ev = 1))) AS ok FROM c),
-- evidence 0 is about cars, 1 about motorcycles; an answer or a question that names only the other clashes with what stands behind it
v AS (SELECT *, ok > 0 AND (k = 1 OR moto = 1) AND NOT (k = 1 AND ev = 0) AND NOT (moto = 1 AND ev = 1) AND NOT (k = 1 AND moto = 1) AS clash FROM s),
f AS (SELECT *, CASE WHEN k = 0 THEN [] ELSE list_filter([CASE WHEN k = 5 THEN 'forbidden phrase' END, CASE WHEN k = 4 THEN 'no citation' END, CASE WHEN clash THEN 'vehicle mismatch' END, CASE WHEN len(cites) > ok THEN 'unsupported citation' END], lambda x: x IS NOT NULL) END AS failures FROM v)
SELECT answer_id, len(failures) = 0 AS is_valid, CAST(len(cites) AS BIGINT) AS n_citations, CAST(ok AS BIGINT) AS n_supported, array_to_string(failures, ',') AS failures FROM f"""


@register("validate_answers", _VALID_SQL)
def validate_answers(spark, sf_dir):
    """Refusals, supported, fabricated, missing and forbidden citations, and vehicles that do not fit, in as many answers as there are documents."""
    docs = docs_of(spark, sf_dir)
    asked = F.when(F.expr("doc_id div 12 % 2 = 1"), F.lit("Đi xe máy?")).otherwise("Thế nào?")
    answers = docs.select(F.col("doc_id").alias("answer_id"), _pick(STATED).alias("answer"), asked.alias("query"))
    row = lambda dieu, khoan, kind: F.struct(F.lit("ND100").alias("doc_short"), F.lit(dieu).alias("dieu"), F.lit(khoan).alias("khoan"), F.lit(None).cast("string").alias("diem"), F.struct(F.array(F.lit(kind)).alias("vehicle_type")).alias("metadata"))
    evidence = docs.select(F.col("doc_id").alias("answer_id"), F.when(F.expr("doc_id div 6 % 2 = 0"), row("5", "5", "o_to")).otherwise(row("6", "1", "xe_may")).alias("e")).select("answer_id", "e.*")
    return cite.validate(answers, evidence).select("answer_id", "is_valid", "n_citations", "n_supported", F.array_join("failures", ",").alias("failures"))
