"""Small rows for the rules of Vietnamese law, and SQL over the same rows."""

from __future__ import annotations


def frame(spark, rows, schema: str):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def values(rows, *columns: str) -> str:
    """Rows of ints, strings and nulls as a FROM item."""

    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") t({', '.join(columns)})"


CLAUSES = [
    (1, "Phạt tiền từ 800.000 đồng đến 1.000.000 đồng đối với người điều khiển xe ô tô chạy quá tốc độ quy định."),
    (2, "Người điều khiển xe mô tô, xe gắn máy không đội mũ bảo hiểm bị phạt tiền từ 400.000 đồng đến 600.000 đồng."),
    (3, "Tước quyền sử dụng Giấy phép lái xe từ 01 tháng đến 03 tháng; tạm giữ phương tiện 07 ngày."),
    (4, "Người đi bộ không chấp hành tín hiệu đèn giao thông."),
    (5, "Buộc khôi phục lại tình trạng ban đầu, tịch thu phương tiện."),
    (6, "Nothing of this kind."),
    (7, "Uống rượu, bia rồi điều khiển xe máy kéo: phạt tiền từ 2,5 đồng đến 3 đồng và phạt tiền từ 9 đồng đến 10 đồng"),
    (8, None),
    (9, ""),
    (10, "XE TẢI chở quá trọng tải, quá số người; ĐỖ XE sai làn, biển số mờ"),
]

_B, _A = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"


def _tags_sql() -> str:
    from .plans import lexicon as L

    def whole(taxonomy):
        parts = []
        for label, pattern in taxonomy.items():
            body = pattern.lower().replace(r"\b", _A)
            parts.append(f"CASE WHEN regexp_matches(lower(text), '{_B}(?:{body}){_A}') THEN '{label}' END")
        return "concat_ws(',', " + ", ".join(parts) + ")"

    def loose(taxonomy):
        parts = [f"CASE WHEN regexp_matches(text, '(?i){pattern}') THEN '{label}' END" for label, pattern in taxonomy.items()]
        return "concat_ws(',', " + ", ".join(parts) + ")"

    return f"SELECT id, {whole(L.VEHICLES)} AS vehicle_type, {whole(L.VIOLATIONS)} AS violation_type, {loose(L.SANCTIONS)} AS sanctions FROM {values(CLAUSES, 'id', 'text')}"


TAGS_SQL = _tags_sql()
_FINE = r"(?i)phạt\s+tiền\s+từ\s+([\d\.\,]+)\s*đồng\s+đến\s+([\d\.\,]+)\s*đồng"
FINES_SQL = (
    f"SELECT id, TRY_CAST(regexp_replace(regexp_extract(text, '{_FINE}', 1), '\\D', '', 'g') AS BIGINT) AS fine_min, "
    f"TRY_CAST(regexp_replace(regexp_extract(text, '{_FINE}', 2), '\\D', '', 'g') AS BIGINT) AS fine_max FROM {values(CLAUSES, 'id', 'text')}"
)

ANSWERS = [
    (1, "Phạt 4.000.000 đồng (Điểm a, Khoản 5, Điều 5 Nghị định 100/2019/NĐ-CP).", "Xe ô tô vượt đèn đỏ?"),
    (2, "Theo quy định (Khoản 9 Điều 99 Nghị định 100/2019/NĐ-CP) và [Khoản 5 Điều 5].", "Xe ô tô?"),
    (3, "Tôi không tìm thấy quy định phù hợp trong văn bản.", "Gì?"),
    (4, "Bạn sẽ bị phạt nặng.", "Xe máy?"),
    (5, "Theo Khoản 1 Điều 6 Nghị định 123/2021/NĐ-CP thì bị phạt. Câu khác.", "xe máy"),
    (6, "Bạn đi đúng luật và không bị phạt.", "xe máy"),
    (7, "Theo tôi, mức phạt cao (Điều 5).", "xe ô tô"),
    (8, "Xem (QCVN 41:2019 biển báo) và (Nghị định 100/2019/NĐ-CP).", None),
    (9, "Người đi bộ bị phạt (Điểm b Khoản 5 Điều 5).", "người đi bộ"),
    (10, None, None),
    (11, "Mức phạt (Điểm c Khoản 1 Điều 6 Nghị định 999/2020/NĐ-CP).", "xe mô tô"),
]
EVIDENCE = [
    (a, *row)
    for a in range(1, 12)
    for row in (
        ("ND100", "5", "5", "a", (["o_to"],)),
        ("ND100", "5", "5", None, (["o_to"],)),
        ("ND100_123", "6", "1", "", (["xe_may"],)),
        ("QCVN41", None, None, None, ([],)),
    )
]
_E = [(a, d, x, y, z) for a, d, x, y, z, _ in EVIDENCE]


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(f, '(?i){pattern}', 1), '')"


CITATIONS_CTE = rf"""
raw AS (SELECT answer_id, coalesce(answer, '') AS answer FROM {values([r[:2] for r in ANSWERS], 'answer_id', 'answer')}),
frags AS (SELECT answer_id, CASE WHEN len(g) > 0 THEN g ELSE string_split_regex(answer, '[.!?]\s+') END AS fs FROM (SELECT answer_id, answer, regexp_extract_all(answer, '[\(\[]([^()\[\]]+)[\)\]]', 1) AS g FROM raw)),
each_ AS (SELECT answer_id, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM frags),
parts AS (SELECT answer_id, i, {_first(r'Điều\s+(\d+)')} AS dieu, {_first(r'Khoản\s+(\d+)')} AS khoan, lower({_first(r'Điểm\s+([a-zđ])')}) AS diem,
  {_first(r'Nghị[\s_]*định\s+(\d+)\s*/\s*\d{4}\s*/\s*NĐ-?CP')} AS decree_number, {_first(r'Nghị[\s_]*định\s+\d+\s*/\s*(\d{4})\s*/\s*NĐ-?CP')} AS decree_year, {_first(r'QCVN\s+([\d:]+)')} AS qcvn FROM each_),
found AS (SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS INTEGER) AS place, dieu, khoan, diem, decree_number, decree_year, qcvn FROM parts WHERE dieu IS NOT NULL OR qcvn IS NOT NULL)
"""
CITATIONS_SQL = f"WITH {CITATIONS_CTE} SELECT * FROM found"
SUPPORT_SQL = f"""WITH {CITATIONS_CTE},
want AS (SELECT *, CASE decree_number || '/' || decree_year WHEN '100/2019' THEN 'ND100' WHEN '123/2021' THEN 'ND123' END AS want FROM found),
ev AS (SELECT * FROM {values(_E, 'answer_id', 'doc', 'd', 'k', 'p')}),
ok AS (SELECT w.answer_id, w.place, bool_or(CASE
    WHEN w.dieu IS NULL AND w.khoan IS NULL AND w.diem IS NULL THEN CASE WHEN w.qcvn IS NOT NULL THEN coalesce(contains(lower(e.doc), 'qcvn'), false) ELSE coalesce(e.doc = w.want OR (e.doc = 'ND100_123' AND w.want IN ('ND100', 'ND123')), false) END
    ELSE (CASE WHEN w.qcvn IS NOT NULL THEN coalesce(contains(lower(e.doc), 'qcvn'), false) ELSE w.want IS NULL OR e.doc IS NULL OR e.doc = w.want OR (e.doc = 'ND100_123' AND w.want IN ('ND100', 'ND123')) END)
      AND (w.dieu IS NULL OR coalesce(e.d = w.dieu, false)) AND (w.khoan IS NULL OR coalesce(e.k = w.khoan, false))
      AND (w.diem IS NULL OR (w.dieu IS NOT NULL AND w.khoan IS NULL) OR coalesce(e.p, '') = '' OR e.p = w.diem) END) AS supported
  FROM want w JOIN ev e USING (answer_id) GROUP BY ALL)
SELECT answer_id, place, supported FROM ok"""

DECREES = [
    (
        "Nghị định 1/2020/NĐ-CP",
        "ND1",
        """Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
Nghị định này quy định về xử phạt.
Chương II
XỬ PHẠT
Mục 1. ĐƯỜNG BỘ
Điều 2. Xử phạt người điều khiển xe ô tô
1. Phạt tiền từ 100.000 đồng đến 200.000 đồng đối với một trong các hành vi sau đây:
a) Không chấp hành tín hiệu đèn;
b) Chuyển hướng không nhường đường;
c) Dừng xe, đỗ xe sai quy định.
2. Phạt tiền từ 300.000 đồng đến 400.000 đồng theo Khoản 1 Điều 2 của Nghị định này.
2. Phạt tiền từ 500.000 đồng đến 600.000 đồng đối với người chạy quá tốc độ.
4. Số này không liền mạch.
Điều 3. Hiệu lực
1. Có hiệu lực từ ngày ký.""",
    ),
    ("Thông tư 2/2021", "TT2", "Điều 1\nPhạm vi\n1) Một.\n2) Hai.\nĐiều 1. Phạm vi lặp lại\n1) Ba."),
    ("Trống", "EMPTY", ""),
]

TABLES = [
    (1, [["Hành vi", "Mức phạt", "Bổ sung"], ["Vượt  đèn\nđỏ", "4-6 triệu", "Tước GPLX"], ["Đỗ xe", "", "Không"]]),
    (2, [["a|b", "c"], ["1", "2", "3"], [None, None], ["", "x"]]),
    (3, [["only", "one row"]]),
    (4, []),
    (5, [["h1", "h2"], ["", ""]]),
]


def _rows_sql() -> str:
    def cell(c):
        return "NULL" if c is None else "'" + c.replace("'", "''") + "'"

    def rows(r):
        return "[" + ", ".join("[" + ", ".join(cell(c) for c in x) + "]" for x in r) + "]::VARCHAR[][]"

    return "(VALUES " + ", ".join(f"({i}, {rows(r)})" for i, r in TABLES) + ") t(id, raw)"


_CLEAN = (
    "list_filter(list_transform(raw, lambda r: list_transform(r, lambda c: trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0)"
)
LINEAR_SQL = f"""WITH t0 AS (SELECT id, {_CLEAN} AS rows FROM {_rows_sql()})
SELECT id, CASE WHEN len(rows) < 2 THEN array_to_string(list_transform(rows, lambda r: array_to_string(r, ' ')), ' ') ELSE
  array_to_string(list_filter(list_transform(rows[2:], lambda r: array_to_string(list_filter(list_transform(r, lambda c, i: CASE WHEN c <> '' THEN coalesce(rows[1][i], 'Cột ' || i) || ': ' || c END), lambda x: x IS NOT NULL), '. ') || '.'), lambda s: s <> '.'), chr(10)) END AS linear FROM t0"""
MARKDOWN_SQL = f"""WITH t0 AS (SELECT id, {_CLEAN} AS rows FROM {_rows_sql()}),
t1 AS (SELECT id, rows, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) AS w FROM t0),
t2 AS (SELECT id, w, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: replace(c, '|', chr(92) || '|')), list_transform(range(w - len(r)), lambda x: '')), ' | ') || ' |') AS ls FROM t1)
SELECT id, CASE WHEN len(ls) = 0 THEN '' ELSE array_to_string(list_concat(ls[1:1], ['| ' || array_to_string(list_transform(range(w), lambda x: '---'), ' | ') || ' |'], ls[2:]), chr(10)) END AS markdown FROM t2"""

QUESTIONS = [
    (1, "Xe máy vượt đèn đỏ và không đội mũ bảo hiểm bị phạt bao nhiêu?"),
    (2, "Ô tô chạy quá tốc độ phạt thế nào"),
    (3, "k mang bằng lái thì sao"),
    (4, "Xe đạp điện uống rượu bị phạt không"),
    (5, "Lái xe trên cao tốc lùi xe; dừng xe sai quy định"),
    (6, "Ô tô và xe máy vượt đèn đỏ, nồng độ cồn gây tai nạn chết người"),
    (7, ""),
    (8, None),
    (9, "Mức 1.5 lít bia có sao không. Hỏi thêm"),
    (10, "nẹt pô bấm điện thoại nghe điện thoại"),
]
REPLIES = [
    (1, "<thought>- Xe: ô tô</thought>\nTrả lời: Phạt 5 đồng."),
    (2, "Chào. <THOUGHT>a\nb</THOUGHT> x </thought> Cuối"),
    (3, "Không có thẻ"),
    (4, "Trả lời:   thẳng"),
    (5, ""),
    (6, None),
]
THOUGHT_SQL = f"""WITH t0 AS (SELECT id, coalesce(text, '') AS text FROM {values(REPLIES, 'id', 'text')}),
t1 AS (SELECT id, regexp_matches(text, '(?is)<thought>(.*?)</thought>') AS hit, text FROM t0),
t2 AS (SELECT id, CASE WHEN hit THEN trim(regexp_extract(text, '(?is)<thought>(.*?)</thought>', 1), ' ' || chr(10)) END AS thought, CASE WHEN hit THEN trim(string_split_regex(text, '(?i)</thought>')[-1], ' ' || chr(10)) ELSE text END AS a FROM t1)
SELECT id, thought, CASE WHEN starts_with(a, 'Trả lời:') THEN trim(substr(a, 9)) ELSE a END AS answer FROM t2"""
AMOUNTS = [(1, "6 triệu"), (2, "400 nghìn"), (3, "18,5 triệu"), (4, "2.25 triệu và 3 ngàn"), (5, "1.234 triệu"), (6, "không có"), (7, ""), (8, "10 triệu 500 nghìn")]
NUMBERS_SQL = "SELECT * FROM " + values([(1, "6000000"), (2, "400000"), (3, "18500000"), (4, "2250000 và 3000"), (5, "1234000"), (6, "không có"), (7, ""), (8, "10000000 500000")], "id", "plain")
JUDGED = [
    (1, "Phạt 6 triệu, tức từ 4.000.000 đồng.", ["4.000.000", "6.000.000"], "x 4.000.000 6.000.000"),
    (2, "Không bị phạt, nhưng phạt tiền từ 9.000.000 đồng.", ["4.000.000"], "không"),
    (3, "Thiếu rồi.", ["4.000.000"], "có 4.000.000"),
    (4, "Thiếu rồi.", ["4.000.000"], "không có"),
    (5, "Phạt nặng.", ["Tôi không tìm thấy"], ""),
    (6, None, [], None),
]
