"""Files as they come: layouts, marks, broken lines; nothing is lost without a reason."""

from eventloom.sources import dirty


def sheets(spark, tmp_path, **files):
    for name, body in files.items():
        (tmp_path / f"{name}.csv").write_text(body, encoding="utf-8")
    rows, rejects = dirty.read_sheets(spark, [str(tmp_path / f"{n}.csv") for n in files])
    return ({r["event_id"]: r for r in rows.collect()}, sorted((r["file"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()))


def test_layouts_marks_and_broken_lines(spark, tmp_path):
    rows, rejects = sheets(
        spark, tmp_path,
        a='event_id,Event Title,Platform,City,Score (1-10)\n1,"Fair, with comma",AllEvents,Cairo,8.5\n2,nan,AllEvents,Giza,1\n3,"says ""hi""",Telegram,Giza,1\n',
        b="remark,city,source,title,event_id,title\nx,Tanta,,Second layout,4,other\n,,nan,Short line,5\ny,Giza,Web,T,6,u,beyond\n",
        c="no,header,here\nat,all,\n",
        d='event_id,Event Title,City\n7,"open,Giza\n8,after it,Giza\n9\n\n')
    assert set(rows) == {"1", "4", "5", "8"}
    assert (rows["1"]["title"], rows["1"]["score"], rows["1"]["city"]) == ("Fair, with comma", 8.5, "Cairo")
    assert (rows["4"]["title"], rows["4"]["city"], rows["4"]["source"], rows["4"]["score"]) == ("Second layout", "Tanta", "Eventbrite", 5.0)
    assert rows["5"]["source"] == "Eventbrite"
    assert rejects == sorted([("a.csv", "no title"), ("a.csv", "skipped source"), ("b.csv", "too many values"), ("c.csv", "no header"), ("c.csv", "no header"),
                              ("d.csv", "open quote"), ("d.csv", "no title")])
    one, _ = dirty.read_sheets(spark, str(tmp_path / "a.csv"))
    assert dirty.accepted(one) is None and dirty.accepted(one, 1).count() == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join([
        '{"event_id":"a","title":"Good","rating":9,"score":null,"extra":{"deep":1}}', '{"event_id":"b","title":"New","rating":1,"score":2.5}',
        '{"event_id":"c","title":"cut', '{"event_id":"d","title":"wrong","score":"high"}', '{"event_id":"e","title":" "}', '[1,2]', "not json", "",
        '{"event_id":"f","title":"Dated","start_date":"2026-10-03T09:00:00","tags":["x"]}']), encoding="utf-8")
    rows, rejects = dirty.read_json(spark, str(tmp_path / "x.json"), {"rating": "score"})
    got = {r["event_id"]: r for r in rows.collect()}
    assert set(got) == {"a", "b", "f"} and got["a"]["score"] == 9.0 and got["b"]["score"] == 2.5 and got["f"]["tags"] == ["x"]
    assert str(got["f"]["start_date"]) == "2026-10-03 09:00:00"
    assert {r["reason"]: r["n"] for r in dirty.counted([rejects]).collect()} == {"broken": 4, "no title": 1}
