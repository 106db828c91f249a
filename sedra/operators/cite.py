"""Legal citations in answers, and whether retrieved evidence supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_group
from ..plans import lexicon as L
from .tag import vehicles_mentioned

# Decrees (number/year) known by a document code, and the code that stands for both.
DECREES = {"100/2019": "ND100", "123/2021": "ND123"}
MERGED = "ND100_123"
REFUSAL = "Tôi không tìm thấy quy định phù hợp"
# Phrases of an answer that says there is no offence, and needs no citation.
LAWFUL = [
    "không bị xử phạt", "không bị phạt", "đúng luật", "không bị phạt tiền",
    "không phải chịu mức phạt", "không có lỗi", "hoàn toàn đúng luật", "không phải chịu bất kỳ mức phạt",
]
FORBIDDEN = ["theo tôi", "theo ý kiến cá nhân", "có thể là"]


def _parsed(fragment: Column) -> Column:
    return F.struct(
        first_group(fragment, r"(?iu)Điều\s+(\d+)").alias("dieu"), first_group(fragment, r"(?iu)Khoản\s+(\d+)").alias("khoan"),
        F.lower(first_group(fragment, r"(?iu)Điểm\s+([a-zđ])")).alias("diem"),
        first_group(fragment, r"(?iu)Nghị[\s_]*định\s+(\d+)\s*/\s*\d{4}\s*/\s*NĐ-?CP").alias("decree_number"),
        first_group(fragment, r"(?iu)Nghị[\s_]*định\s+\d+\s*/\s*(\d{4})\s*/\s*NĐ-?CP").alias("decree_year"), first_group(fragment, r"(?iu)QCVN\s+([\d:]+)").alias("qcvn"),
    )


def citations(text: Column) -> Column:
    """The citations of a text in order: of its bracketed groups, or of its sentences where there are none.

    A fragment counts only if it names an article or a technical regulation.
    """
    text = F.coalesce(text, F.lit(""))
    groups = F.regexp_extract_all(text, F.lit(r"[\(\[]([^()\[\]]+)[\)\]]"), F.lit(1))
    parts = F.when(F.size(groups) > 0, groups).otherwise(F.split(text, r"(?<=[.!?])\s+"))
    return F.filter(F.transform(parts, _parsed), lambda c: c["dieu"].isNotNull() | c["qcvn"].isNotNull())


def cited(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """(answer_id, place, dieu, khoan, diem, decree_number, decree_year, qcvn): a row for each citation."""
    return answers.select("answer_id", F.posexplode(citations(F.col(text_col))).alias("place", "c")).select("answer_id", "place", "c.*")


def chunk_citation(df: DataFrame) -> DataFrame:
    """doc_short, dieu, khoan and diem as strings, diem in lower case."""
    return df.withColumns({"dieu": F.col("dieu").cast("string"), "khoan": F.col("khoan").cast("string"), "diem": F.lower(F.col("diem").cast("string"))})


def expected_document() -> Column:
    known = F.create_map(*[F.lit(x) for pair in DECREES.items() for x in pair])
    return F.try_element_at(known, F.concat_ws("/", F.col("decree_number"), F.col("decree_year")))


def support(c: str = "c", e: str = "e") -> Column:
    """Whether evidence row e supports citation row c.

    The levels cited must be equal, from the article down as far as they hang together; evidence without a
    point stands for all points of its clause. A technical regulation cited wants a code with qcvn; a known
    decree wants its code; an unknown one leaves the document open.
    """
    col = lambda t, n: F.col(f"{t}.{n}")
    is_qcvn = F.coalesce(F.contains(F.lower(col(e, "doc_short")), F.lit("qcvn")), F.lit(False))
    want, have = col(c, "expected_doc"), col(e, "doc_short")
    named = F.coalesce((have == want) | ((have == MERGED) & want.isin(*DECREES.values())), F.lit(False))
    doc = F.when(col(c, "qcvn").isNotNull(), is_qcvn).otherwise(want.isNull() | have.isNull() | named)
    same = lambda n: F.coalesce(col(e, n) == col(c, n), F.lit(False))
    point = same("diem") | (F.coalesce(col(e, "diem"), F.lit("")) == "")
    dieu, khoan, diem = (col(c, n).isNotNull() for n in ("dieu", "khoan", "diem"))
    return (
        F.when(~dieu & ~khoan & ~diem, F.when(col(c, "qcvn").isNotNull(), is_qcvn).otherwise(named))
        .when(dieu & khoan & diem, doc & same("dieu") & same("khoan") & point)
        .when(dieu & khoan, doc & same("dieu") & same("khoan"))
        .when(dieu, doc & same("dieu"))
        .when(khoan & diem, doc & same("khoan") & point)
        .when(khoan, doc & same("khoan"))
        .otherwise(doc & point)
    )


def supported(citations_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations with `supported`. evidence: (answer_id, doc_short, dieu, khoan, diem, ...), a few rows for each answer."""
    c = citations_.withColumn("expected_doc", expected_document()).alias("c")
    e = chunk_citation(evidence).alias("e")
    hit = c.join(e, (F.col("c.answer_id") == F.col("e.answer_id")) & support(), "left_semi").select("answer_id", "place")
    return citations_.join(hit.withColumn("supported", F.lit(True)), ["answer_id", "place"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def hallucinated(citations_: DataFrame, evidence: DataFrame) -> DataFrame:
    return supported(citations_, evidence).where(~F.col("supported")).drop("supported")


def _any(low: Column, phrases) -> Column:
    return F.filter(F.array(*[F.lit(p.lower()) for p in phrases]).cast("array<string>"), lambda p: F.contains(low, p))


def validate(answers: DataFrame, evidence: DataFrame, require_one: bool = True, forbidden=FORBIDDEN, refusal: str = REFUSAL) -> DataFrame:
    """(answer_id, is_valid, n_citations, n_supported, n_hallucinated, forbidden_hit, failures) for each answer.

    answers (answer_id, answer, query); evidence as for supported, with metadata.vehicle_type. A refusal is
    valid. Else: no forbidden phrase; a citation, unless the answer says that all is lawful; every citation
    supported; and the vehicles of question and answer meet those of the evidence behind each citation.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    base = answers.select(
        "answer_id", F.contains(low, F.lit(refusal.lower())).alias("refused"), _any(low, forbidden).alias("forbidden_hit"), (F.size(_any(low, LAWFUL)) > 0).alias("lawful"),
        F.array_union(vehicles_mentioned(F.col("query")), vehicles_mentioned(F.col("answer"))).alias("vehicles"),
    )
    found = supported(cited(answers), evidence)
    c = found.withColumn("expected_doc", expected_document()).where("supported").alias("c")
    e = chunk_citation(evidence).withColumn("kinds", F.coalesce("metadata.vehicle_type", F.array().cast("array<string>"))).alias("e")
    have, want = F.col("e.doc_short"), F.col("c.expected_doc")
    open_doc = want.isNull() | have.isNull() | (have == want) | ((have == MERGED) & want.isin(*DECREES.values()))
    level = lambda n: F.col(f"c.{n}").isNull() | F.coalesce(F.col(f"e.{n}") == F.col(f"c.{n}"), F.lit(False))
    point = level("diem") | (F.coalesce("e.diem", F.lit("")) == "")
    behind = c.join(e, (F.col("c.answer_id") == F.col("e.answer_id")) & F.coalesce(open_doc, F.lit(True)) & level("dieu") & level("khoan") & point)
    kinds = behind.groupBy(F.col("c.answer_id").alias("answer_id"), F.col("c.place").alias("place")).agg(F.array_distinct(F.flatten(F.collect_list("e.kinds"))).alias("kinds"))
    clash = kinds.join(base.select("answer_id", "vehicles"), "answer_id")
    clash = clash.where((F.size("vehicles") > 0) & (F.size("kinds") > 0) & ~F.arrays_overlap("vehicles", "kinds")).groupBy("answer_id").agg(F.count("*").alias("n_clash"))
    n = found.groupBy("answer_id").agg(F.count("*").alias("n"), F.sum(F.col("supported").cast("long")).alias("ok"))
    out = base.join(n, "answer_id", "left").join(clash, "answer_id", "left").na.fill(0, ["n", "ok", "n_clash"])
    failures = F.array_compact(
        F.array(
            F.when(F.size("forbidden_hit") > 0, "forbidden phrase"), F.when((F.col("n") == 0) & ~F.col("lawful") & F.lit(require_one), "no citation"),
            F.when(F.col("n_clash") > 0, "vehicle mismatch"), F.when(F.col("n") > F.col("ok"), "unsupported citation"),
        )
    )
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    free = lambda x, y: F.when(F.col("refused"), y).otherwise(x)
    return out.select(
        "answer_id", (F.size(free(failures, none)) == 0).alias("is_valid"), free(F.col("n"), zero).alias("n_citations"), free(F.col("ok"), zero).alias("n_supported"),
        free(F.col("n") - F.col("ok"), zero).alias("n_hallucinated"), free(F.col("forbidden_hit"), none).alias("forbidden_hit"), free(failures, none).alias("failures"),
    )


def tag_of(unknown: str = "[Không rõ nguồn]") -> Column:
    """The bracketed citation tag of a chunk's levels and document."""
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(name + " "), F.col(c)))
    known = F.create_map(*[F.lit(x) for pair in L.DOCUMENT_NAMES.items() for x in pair])
    doc = F.nullif(F.coalesce(F.try_element_at(known, F.col("doc_short")), F.col("doc_short")), F.lit(""))
    inner = F.concat_ws(", ", part("Điểm", "diem"), part("Khoản", "khoan"), part("Điều", "dieu"), doc)
    return F.when(inner == "", unknown).otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def hallucination_rate(citations_: DataFrame) -> DataFrame:
    """(answer_id, rate): unsupported over all of an answer's citations."""
    return citations_.groupBy("answer_id").agg((F.sum((~F.col("supported")).cast("double")) / F.count("*")).alias("rate"))
