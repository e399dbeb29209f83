"""One meeting from its captions to its tasks."""

from __future__ import annotations

from tessera.operators import meeting

CAPTION = "meeting_id long, caption_id string, speaker_raw string, start_ms long, end_ms long, text_raw string, order_index long"


def captions(spark, said, number=1):
    return spark.createDataFrame([(number, f"CAP-{i:06d}", who, 9000 * i, 9000 * i + 900, text, i) for i, (who, text) in enumerate(said)], CAPTION)


def test_from_captions_to_final_tasks(spark):
    said = [
        ("An", "Chào mọi người"), ("An", "Bình, em hãy gửi báo cáo doanh thu trước ngày 20/02/2024 nhé"), ("Bình", "Dạ vâng"), ("Chi", "Em sẽ chuẩn bị hợp đồng mẫu"), ("Chi", "Em sẽ cấu hình sandbox thanh toán trước ngày 25/02/2024"),
        ("An", "Hủy task cấu hình sandbox thanh toán"), ("An", "Có cần cập nhật tài liệu không"), ("An", "Recap lần cuối nhé"), ("An", "Task 1 - Chi, chuẩn bị hợp đồng mẫu - deadline 22/02/2024"), ("An", "Task 2 - Dũng, kiểm tra dashboard"),
    ]
    found = {r.task_name: r for r in meeting.from_captions(captions(spark, said), "2024-02-01").collect()}
    assert {k: (r.assignee, r.due_date, r.due_text, r.start_date) for k, r in found.items()} == {
        "Gửi báo cáo doanh thu": ("Bình", "2024-02-19", "trước ngày 20/02/2024", "2024-02-01"), "Chuẩn bị hợp đồng mẫu": ("Chi", "2024-02-22", "deadline 22/02/2024", "2024-02-01"), "Kiểm tra dashboard": ("Dũng", "", "", "2024-02-01"),
    }
    assert found["Chuẩn bị hợp đồng mẫu"].evidence == "Chi: Em sẽ chuẩn bị hợp đồng mẫu\nAn: Task 1 - Chi, chuẩn bị hợp đồng mẫu - deadline 22/02/2024"
