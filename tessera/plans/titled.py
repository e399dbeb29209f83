"""Queries over titles, and the precision of selected spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import auditing, titles
from tessera.plans.rendered import table
from tessera.plans.said import sql_text

#: Openings of transcripts, the title given with them, and the title that they must get ({n} is the conversation's number).
OPENINGS = (
    ("TITLE: Ngân sách quý {n}\\n[00:00:01] An: Chào", "Họp tuần", "Ngân sách quý {n}"),
    ("[00:00:01] An: Hôm nay chúng ta họp về kế hoạch phát hành {n} nhé mọi người", "W1-{n}", "Kế hoạch phát hành {n}"),
    ("T000001 [00:00:01] An: Chào\\nT000002 [00:00:05] An: Hôm nay mình sẽ rà soát Hợp đồng ngân hàng {n}. Rồi nghỉ.", "", "Rà soát hợp đồng ngân hàng {n}"),
    ("An: Review nội dung chính: check tiến độ dashboard {n}, ", "meeting-{n}", "Tiến độ dashboard {n}"),
    ("An: Chào mọi người", "Họp dự án {n}", "Họp dự án {n}"),
    ("00:00 --> 00:05 hôm nay họp về lỗi {n}\\nAn: Không có gì", "upload-{n}", "Chưa có tiêu đề"),
    ("An: Hôm nay cần thống nhất thảo luận các phương án mở rộng kho {n}!", "A-B-C-{n}", "Mở rộng kho {n}"),
)


def src14_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each conversation, whose texts follow an opening."""
    n, said = F.col("conv_id"), F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias("body"))
    of = lambda i: F.replace(F.element_at(F.array(*(F.lit(o[i].replace("\\n", "\n")) for o in OPENINGS)), (n % len(OPENINGS)).cast("int") + 1), F.lit("{n}"), n.cast("string"))
    whole = F.concat_ws("\n", of(0), "body")
    return rows.select("conv_id", titles.title(of(1), whole, F.lit("Chưa có tiêu đề")).alias("title"))


SRC14 = f"""SELECT conv_id, replace([{", ".join(sql_text(o[2]) for o in OPENINGS)}][conv_id % {len(OPENINGS)} + 1], '{{n}}', CAST(conv_id AS VARCHAR)) AS title FROM conversations GROUP BY conv_id"""


def off10_selected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected spans of orders' cases against the right ones: counts, precision, recall and F1 of exact spans, by priority."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("wave"), F.col("o_custkey").alias("case_id"), (k % 50).alias("clause_id"), (k % 9).alias("start"), (k % 9 + 5).alias("end"), k)
    gold = rows.where(k % 3 != 0).select("wave", "case_id", "clause_id", "start", "end").distinct()
    ranked = rows.where(k % 4 != 0).withColumn("grounded", k % 10 != 0)
    selected = ranked.where("grounded").select("wave", "case_id", "clause_id", F.when(k % 7 == 0, F.col("start") + 1).otherwise(F.col("start")).alias("start"), "end").distinct()
    keys = ["wave", "case_id", "clause_id", "start", "end"]
    both = gold.withColumn("g", F.lit(1)).join(selected.withColumn("s", F.lit(1)), keys, "full").groupBy("wave").agg(F.count("g").alias("expected"), F.count("s").alias("selected"), F.count(F.when(F.col("g").isNotNull() & F.col("s").isNotNull(), 1)).alias("matched"))
    errors = ranked.groupBy("wave").agg(F.count_if(~F.col("grounded")).alias("errors"))
    precision, recall = F.when(F.col("selected") > 0, F.col("matched") / F.col("selected")).otherwise(0.0), F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    out = both.join(errors, "wave", "left")
    return out.select("wave", "expected", "selected", "matched", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.coalesce("errors", F.lit(0)).alias("errors"))


OFF10 = """WITH r AS (SELECT o_orderpriority AS wave, o_custkey AS case_id, o_orderkey AS k, o_orderkey % 50 AS c, o_orderkey % 9 AS s FROM orders),
g AS (SELECT DISTINCT wave, case_id, c, s, s + 5 AS e FROM r WHERE k % 3 <> 0), p AS (SELECT DISTINCT wave, case_id, c, CASE WHEN k % 7 = 0 THEN s + 1 ELSE s END AS s, s + 5 AS e FROM r WHERE k % 4 <> 0 AND k % 10 <> 0),
n AS (SELECT wave, (SELECT count(*) FROM g WHERE g.wave = w.wave) AS expected, (SELECT count(*) FROM p WHERE p.wave = w.wave) AS selected, (SELECT count(*) FROM g JOIN p USING (wave, case_id, c, s, e) WHERE wave = w.wave) AS matched,
  (SELECT count(*) FROM r WHERE r.wave = w.wave AND k % 4 <> 0 AND k % 10 = 0) AS errors FROM (SELECT DISTINCT wave FROM r) w)
SELECT wave, expected, selected, matched, round(matched / selected, 6) AS precision, round(matched / expected, 6) AS recall, round(2.0::DOUBLE * matched / (selected + expected), 6) AS f1, errors FROM n"""

#: Expected tasks (name, owner, start, due, words of it) of a case whose transcript is TRANSCRIPT, and the issues of each.
TRANSCRIPT = "An: Bình gửi báo cáo doanh thu trước ngày 20/02/2024 nhé\nChi: Em sẽ kiểm tra dashboard trong hôm nay, deadline 2024-02-13"
EXPECTED = (
    ("Gửi báo cáo doanh thu", "Bình", "", "2024-02-19", "trước ngày 20/02/2024", ()),
    ("Kiểm tra dashboard", "Chi", "2024-02-01", "2024-02-14", "deadline 2024-02-13", (("WARNING", "due_date", "does_not_match_due_date_text"),)),
    ("Mua máy chủ mới", "Dũng", "", "", "", (("ERROR", "task_name", "low_transcript_token_overlap"), ("ERROR", "assignee", "not_found_in_transcript"))),
    ("", "Chi", "2024-02-10", "2024-02-05", "", (("ERROR", "task_name", "empty"), ("ERROR", "due_date", "before_start_date"))),
    ("Kiểm tra dashboard", "chi", "2024/02/01", "2024-13-01", "", (("ERROR", "task", "duplicate_task_identity"), ("ERROR", "start_date", "invalid_iso_date"), ("ERROR", "due_date", "invalid_iso_date"))),
    ("Gửi báo cáo", "An; Bình", "", "2024-02-21", "21/02/2024", (("WARNING", "due_date_text", "not_exactly_found_in_transcript"),)),
    ("Gửi doanh thu", "", "", "", "trong 3 ngày làm việc", (("WARNING", "due_date_text", "not_exactly_found_in_transcript"),)),
)


def dat17_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the tasks expected of each customer's meeting; every fifth has no tasks and no transcript."""
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("2024-02-01").alias("meeting_date"), F.when(F.col("c_custkey") % 5 != 0, TRANSCRIPT).alias("transcript"))
    rows = spark.createDataFrame([(i, *e[:5]) for i, e in enumerate(EXPECTED)], "task_no int, task_name string, assignee string, start_date string, due_date string, due_date_text string")
    each = F.explode(F.sequence(F.lit(0), F.lit(len(EXPECTED) - 1))).alias("task_no")
    tasks = cases.where("transcript is not null").select("case_id", each).join(F.broadcast(rows), "task_no")
    return auditing.issues(tasks, cases)


DAT17 = f"""SELECT c_custkey AS case_id, task_no, level, field, issue FROM customer, (VALUES {", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, e in enumerate(EXPECTED) for a, b, c in e[5])}) t(task_no, level, field, issue) WHERE c_custkey % 5 <> 0"""

QUERIES = {"dat17_audit": (dat17_audit, DAT17), "src14_titles": (src14_titles, SRC14), "off10_selected_spans": (off10_selected_spans, OFF10)}
