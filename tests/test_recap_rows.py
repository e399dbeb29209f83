"""Recaps: golden meetings, a form of rows each, in both languages."""

from __future__ import annotations

from tessera.operators import recap_rows as R

CLAUSES = "meeting_id long, clause_id string, order_index int, speaker_name string, text_raw string"


def meeting(*said, number=1):
    return [(number, f"C{i}", i, speaker, text) for i, (speaker, text) in enumerate(said)]


TALK = [("An", "Chào mọi người"), ("Bình", "Em đang cấu hình sandbox thanh toán"), ("Chi", "ok")]


def read(spark, rows):
    found = R.segment_deadlines(R.events(spark.createDataFrame(rows, CLAUSES)))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.meeting_id, r.order_index, r.place)):
        out.setdefault(r.meeting_id, []).append((r.form, r.event_type, r.action_text, r.assignee, r.deadline_text))
    return out


def test_every_form_of_a_recap(spark):
    meetings = [
        meeting(*TALK, ("An", "Recap lần cuối nhé"), ("Chi", "Vâng"), ("An", "Task 1 - Bình, viết báo cáo doanh thu - deadline 20/02/2024"), ("Chi", "ok"), ("An", "Task 2: Chi, kiểm tra dashboard, hạn 21/02/2024"),
                ("An", "Task 3 - Bình, đã hủy"), ("Chi", "Em muốn hỏi thêm một việc khác"), ("An", "Task 4 - An, gửi tài liệu"), number=1),
        meeting(*TALK, ("An", "Final recap of the meeting"), ("An", "Task review the contract mới, owner Bình, deadline 2024-02-20"), ("An", "và task update the dashboard, do Chi"), number=2),
        meeting(*TALK, ("An", 'Tổng kết toàn bộ: task "Viết báo cáo" - owner Bình, deadline 20/02/2024; task "Release plan": đã hủy'), number=3),
        meeting(("An", 'Task A: "Viết kịch bản kiểm thử" do Bình phụ trách'), ("An", 'Task B: "Gửi tài liệu"'), ("Chi", 'Task B đổi tên thành "Gửi tài liệu hướng dẫn"'), ("An", "Recap cuối: A (Bình, 20/02/2024) và B (Chi)"), number=4),
        meeting(*TALK, ("An", "Final list - Bình: viết báo cáo tuần, dl 20/02/2024 - Chi: chuẩn bị dữ liệu test - Khách: chờ"), number=5),
        meeting(*TALK, ("An", "Recap lại tổng thể"), ("An", "Bình: cấu hình"), ("An", "viết báo cáo tuần trước ngày 21/02/2024"), ("An", "Chi: cái này chưa chốt"), ("An", "Tôi sẽ kiểm tra dashboard"), number=6),
        meeting(*TALK, *TALK, ("An", "Chốt lại: Bình - viết báo cáo tuần; release notes: Chi, ngày 20/02/2024; các task khác giữ nguyên"), ("An", "thứ ba, em kiểm tra dashboard"), number=7),
        meeting(*TALK, ("An", "Recap nhanh: viết tài liệu API do Chi đang làm và Bình phụ trách viết báo cáo tuần và gửi email cho khách"), ("Chi", "ok"), ("An", "Chi kiểm tra dashboard"), number=8),
        meeting(*TALK, number=9),
    ]
    got = read(spark, [r for m in meetings for r in m])
    assert got == {
        1: [("NUMBERED", "OWNER_ASSIGN", "Viết báo cáo doanh thu", "Bình", "deadline 20/02/2024"), ("NUMBERED", "OWNER_ASSIGN", "Kiểm tra dashboard", "Chi", "21/02/2024")],
        2: [("NUMBERED", "OWNER_ASSIGN", "Review the contract", "Bình", "deadline 2024-02-20"), ("NUMBERED", "OWNER_ASSIGN", "Update the dashboard", "Chi", "")],
        3: [("INLINE", "OWNER_ASSIGN", "Viết báo cáo", "Bình", "deadline 20/02/2024"), ("INLINE", "TASK_CANCEL", "Lập Release plan", "", "")],
        4: [("COMPACT", "OWNER_ASSIGN", "Viết kịch bản kiểm thử", "Bình", "20/02/2024"), ("COMPACT", "OWNER_ASSIGN", "Gửi tài liệu hướng dẫn", "Chi", "")],
        5: [("BULLET", "OWNER_ASSIGN", "Viết báo cáo tuần", "Bình", "20/02/2024"), ("BULLET", "OWNER_ASSIGN", "Chuẩn bị dữ liệu test", "Chi", "")],
        6: [("SECTION", "OWNER_ASSIGN", "Cấu hình sandbox thanh toan", "Bình", ""), ("SECTION", "OWNER_ASSIGN", "Viết báo cáo tuần", "Bình", "trước ngày 21/02/2024"), ("SECTION", "OWNER_ASSIGN", "Kiểm tra dashboard", "An", "")],
        7: [("STRUCTURED", "OWNER_ASSIGN", "Viết Release notes", "Chi", "ngày 20/02/2024"), ("STRUCTURED", "OWNER_ASSIGN", "Kiểm tra dashboard", "An", "")],
        # an action that stands before its owner goes to every owner after it, and what follows such an owner isn't read again
        8: [("NAMED", "OWNER_ASSIGN", "Viết tài liệu API do", "Chi", ""), ("NAMED", "OWNER_ASSIGN", "Viết tài liệu API do Chi đang làm", "Bình", "")],
    }


def test_a_block_ends_where_another_takes_up_the_talk(spark):
    said = [("An", "Recap cuối"), ("Chi", "Đợi em mở file"), ("Chi", "Xong"), ("An", "Bình: viết báo cáo"), ("Chi", "ok"), ("An", "gửi tài liệu"), ("Bình", "Em hỏi chút"), ("An", "Chi: kiểm tra dashboard")]
    late = [("An", "Recap cuối"), *[("Chi", f"Chuyện khác {i}") for i in range(4)], ("An", "Bình: viết báo cáo")]
    rows = meeting(*said, number=1) + meeting(*late, number=2) + meeting(("An", "Recap cuối"), *[("An", f"dòng {i}") for i in range(50)], number=3)
    found = {}
    for r in R.final_block(spark.createDataFrame(rows, CLAUSES)).collect():
        found.setdefault(r.meeting_id, []).append(r.order_index)
    assert sorted(found[1]) == [0, 3, 5] and sorted(found[2]) == [0] and sorted(found[3]) == list(range(35))
