"""Ranking and answer metrics as roll-ups. Runs are rows (query, doc, rank); gold is rows (query, doc)."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import ship

MONEY = r"(?<![\p{L}\p{N}_])\d{1,3}(?:\.\d{3})+(?![\p{L}\p{N}_])"


def per_query(run: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """(query, n_gold, rr, recall_<k>, precision_<k> ...) for each query with gold; others are skipped.

    recall: gold found in the first k over all gold; precision: gold found over min(k, returned); rr: one over
    the first hit's rank, 0 without one.
    """
    gold = gold.select("query", "doc").distinct()
    hits = run.select("query", "doc", "rank").join(gold.withColumn("hit", F.lit(1)), ["query", "doc"], "left")
    found = F.coalesce("hit", F.lit(0))
    aggs = [F.count("*").alias("returned"), F.min(F.when(found == 1, F.col("rank"))).alias("first")]
    aggs += [F.sum(F.when(F.col("rank") <= k, found).otherwise(0)).alias(f"hits_{k}") for k in ks]
    out = gold.groupBy("query").agg(F.count("*").alias("n_gold")).join(hits.groupBy("query").agg(*aggs), "query", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    recall = [(n(f"hits_{k}") / F.col("n_gold")).alias(f"recall_{k}") for k in ks]
    precision = [F.coalesce(F.try_divide(n(f"hits_{k}"), F.least(F.lit(k), n("returned"))), F.lit(0.0)).alias(f"precision_{k}") for k in ks]
    return out.select("query", "n_gold", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), *recall, *precision)


def stage(run: DataFrame, gold: DataFrame, name: str, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """(stage, metric, k, value): means over the queries with gold; k is null for mrr."""
    each = per_query(run, gold, ks)
    values = [F.struct(F.lit("mrr").alias("metric"), F.lit(None).cast("int").alias("k"), F.avg("rr").alias("value"))]
    values += [F.struct(F.lit(m).alias("metric"), F.lit(k).cast("int").alias("k"), F.avg(f"{m}_{k}").alias("value")) for m in ("recall", "precision") for k in ks]
    return each.agg(F.array(*values).alias("v")).select(F.lit(name).alias("stage"), F.inline("v"))


def lift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, k, before, after, abs_lift, rel_lift_pct) of two stages; the relative lift over 0 is infinite."""
    a = before.select("metric", "k", F.col("value").alias("before"))
    b = after.select(F.col("metric").alias("m"), F.col("k").alias("kk"), F.col("value").alias("after"))
    both = a.join(b, (F.col("metric") == F.col("m")) & F.col("k").eqNullSafe(F.col("kk"))).drop("m", "kk")
    diff = F.col("after") - F.col("before")
    return both.select("metric", "k", "before", "after", diff.alias("abs_lift"), F.when(F.col("before") > 0, 100.0 * diff / F.col("before")).otherwise(float("inf")).alias("rel_lift_pct"))


def to_markdown(rows: Sequence) -> str:
    """A small table of lift rows for people."""
    out = ["| Metric | Before | After | Δ |", "|---|---|---|---|"]
    for r in sorted(rows, key=lambda r: (r["metric"], r["k"] or 0)):
        label = r["metric"].upper() if r["k"] is None else f"{r['metric'].capitalize()}@{r['k']}"
        out.append(f"| {label} | {r['before']:.3f} | {r['after']:.3f} | {r['abs_lift']:+.3f} |")
    return "\n".join(out)


def write_metrics(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is an error."""
    if not df.limit(1).count():
        raise ValueError("there are no rows to write")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


# --- answers ---------------------------------------------------------------------------------------------


def expected_fines(text: Column) -> Column:
    """Amounts like 10.600.000."""
    return F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))


def expected_citations(text: Column) -> Column:
    """Distinct tags: dieu_<n>, khoan_<n>, diem_<x>, QCVN_41, LUAT_TTATGT."""

    def level(name: str, what: str, tag: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu){name}\s+({what})"), F.lit(1)), lambda x: F.concat(F.lit(f"{tag}_"), F.lower(x)))

    tags = [level("Điều", r"\d+", "dieu"), level("Khoản", r"\d+", "khoan"), level("Điểm", "[a-zđ]", "diem")]
    law = F.when(F.contains(text, F.lit("TTATGT")) | F.contains(F.lower(text), F.lit("trật tự")), "LUAT_TTATGT")
    return F.array_distinct(F.array_compact(F.concat(*tags, F.array(F.when(F.contains(text, F.lit("QCVN 41")), "QCVN_41"), law))))


def citation_coverage(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case, coverage): the share of a case's expected tags that some retrieved chunk carries; 1 where none are expected.

    cases (case, tags); retrieved (case, chunk_id, text, dieu, khoan, diem). A level is carried by the chunk's own
    field or by its id, whose parts are compared whole: dieu_5 is not in dieu_57.
    """
    each = cases.select("case", F.explode("tags").alias("tag"))
    kind, value = F.substring_index("tag", "_", 1), F.element_at(F.split("tag", "_"), 2)
    low_id, low_text = F.lower(F.coalesce("chunk_id", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    in_id = F.regexp_like(low_id, F.concat(F.lit("(^|[^a-z])"), kind, F.lit("_?"), value, F.lit("($|[^0-9a-zđ])")))
    field = F.when(kind == "dieu", F.col("dieu")).when(kind == "khoan", F.col("khoan")).when(kind == "diem", F.lower("diem"))
    carried = (
        F.when(F.col("tag") == "QCVN_41", F.contains(low_text, F.lit("qcvn 41")) | F.contains(low_id, F.lit("qcvn")))
        .when(F.col("tag") == "LUAT_TTATGT", F.contains(low_id, F.lit("ttatgt")) | F.contains(low_text, F.lit("luật trật tự")))
        .otherwise(in_id | F.coalesce(field == value, F.lit(False)))
    )
    covered = each.join(retrieved, "case").where(carried).select("case", "tag").distinct().groupBy("case").agg(F.count("*").alias("n"))
    out = cases.join(covered, "case", "left")
    return out.select("case", F.when(F.size("tags") == 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.size("tags")).alias("coverage"))


def spelled_numbers(text: Column) -> Column:
    """'18,5 triệu' and '400 nghìn' as digits. A fraction of one digit counts hundred thousands, of two ten thousands, of more thousands."""
    million, thousand = r"(\d+)[.,](\d+)\s*triệu|(\d+)\s*triệu", r"(\d+)\s*(?:nghìn|ngàn)"
    number = lambda digits: F.when(digits == "", "0").otherwise(digits).cast("decimal(28,0)")

    def each(text: Column, pattern: str, value) -> Column:
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(gaps, F.transform(found, value), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    def of_million(m: Column) -> Column:
        part = F.regexp_extract(m, r"^\d+[.,](\d+)", 1)
        scale = F.when(F.length(part) == 1, 100000).when(F.length(part) == 2, 10000).otherwise(1000)
        return (number(F.regexp_extract(m, r"^(\d+)", 1)) * 1000000 + number(part) * scale).cast("decimal(38,0)").cast("string")

    def of_thousand(m: Column) -> Column:
        return (number(F.regexp_extract(m, r"^(\d+)", 1)) * 1000).cast("decimal(38,0)").cast("string")

    return each(each(text, million, of_million), thousand, of_thousand)


def calculation_accuracy(answer: Column, fines: Column) -> Column:
    """1 if every expected amount is in the answer as a whole number, spelled or in digits; 1 where none is expected."""
    plain = F.regexp_replace(spelled_numbers(F.coalesce(answer, F.lit(""))), "[.,]", "")
    there = F.forall(fines, lambda x: F.regexp_like(plain, F.concat(F.lit("(?<!\\d)"), F.regexp_replace(x, "[.,]", ""), F.lit("(?!\\d)"))))
    return F.when(there, 1.0).otherwise(0.0)


def invented_amounts(answer: Column, expected: Column) -> Column:
    """Amounts of the answer that no expected keyword has."""
    known = F.flatten(F.transform(expected, expected_fines))
    return F.array_except(expected_fines(F.coalesce(answer, F.lit(""))), known)


def missing(answer: Column, wanted: Column) -> Column:
    """The wanted phrases that are not in the answer, whatever their case."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.filter(wanted, lambda w: ~F.contains(low, F.lower(w)))


# Phrases that deny a fine, and that state one.
NO_FINE = ["không bị phạt", "không bị xử phạt", "không vi phạm", "được miễn"]
STATES_FINE = ["phạt tiền từ", "bị phạt tiền", "mức phạt là"]


def self_contradiction(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    some = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.contains(low, p))
    return some(NO_FINE) & some(STATES_FINE)


def citation_drift(answer: Column, targets: Column) -> Column:
    """Whether any target's first part (up to a comma) is not in the answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(targets, lambda t: ~F.contains(low, F.trim(F.substring_index(F.lower(t), ",", 1))))


def root_cause(answer: Column, expected: Column, context: Column, refusal: str = "tôi không tìm thấy") -> Column:
    """Hallucination, Retrieval_Drift, Context_Loss, or null for an answer that passes."""
    gone = missing(answer, expected)
    refused = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(refusal))
    low = F.lower(F.coalesce(context, F.lit("")))
    ladder = F.when(F.size(gone) == 0, F.lit(None).cast("string")).when(refused(F.get(expected, F.lit(0))), "Hallucination")
    ladder = ladder.when(F.exists(gone, lambda w: ~F.contains(low, F.lower(w))), "Retrieval_Drift").otherwise("Context_Loss")
    return F.when((F.size(invented_amounts(answer, expected)) > 0) & ~refused(answer), "Hallucination").otherwise(ladder)


# Causes of a kind of test's errors.
CAUSES = {
    "vehicle_bias": (["missing_entities"], "query deconstruction"),
    "multi_turn": (["missing_entities", "citation_drift"], "query reformulation"),
    "exception_clause": (["self_contradiction"], "prompt and context"),
    "numeric_trap": (["self_contradiction", "citation_drift"], "numeric trap"),
}


def failure_mode(test_type: Column, errors: Column) -> Column:
    out = None
    for kind, (signs, cause) in CAUSES.items():
        test = (test_type == kind) & F.arrays_overlap(errors, F.array(*[F.lit(s) for s in signs]))
        out = F.when(test, cause) if out is None else out.when(test, cause)
    return out.otherwise("unclassified")


def suite(cases: DataFrame) -> DataFrame:
    """Means of the columns coverage, accuracy, hallucination_rate and passed over all cases; a failed case's nulls count as 0."""
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
    return cases.agg(F.count("*").alias("n_cases"), *[mean(c) for c in ("coverage", "accuracy", "hallucination_rate", "passed")])


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def _json_values(text: str) -> Iterator[str]:
    """Each element of the JSON arrays in text, and what stands outside of arrays, as JSON; from a mistake on, the rest as it is."""
    decoder, text, at = json.JSONDecoder(), text.lstrip("\ufeff").strip(), 0
    while at < len(text):
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            yield text[at:]
            return
        yield from map(json.dumps, value if isinstance(value, list) else [value])
        while text[at : at + 1].isspace():
            at += 1


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Test cases from files of JSON arrays, over any number of lines, one array in a file or several after each other."""
    ship(spark)
    return spark.read.json(spark.read.text(path, wholetext=True).rdd.flatMap(lambda r: _json_values(r.value)))


JUDGED = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def judged(cases: DataFrame, judge, metrics: Sequence[str] = JUDGED) -> DataFrame:
    """cases (question, answer, contexts, ground_truth) with a column for each metric.

    judge(metric, question, answer, contexts, ground_truth) gives a column of scores, say a UDF around a model.
    """
    return cases.withColumns({m: judge(m, *[F.col(c) for c in ("question", "answer", "contexts", "ground_truth")]).cast("double") for m in metrics})
