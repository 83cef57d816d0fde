import pytest

from citeframe.engine import Engine
from test_operators import LEASE, NOTES


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    files = spark.createDataFrame([("lease.txt", LEASE), ("notes.txt", NOTES), ("copy.txt", LEASE), ("empty.txt", "  ")], "name string, text string")
    got = {r["name"]: (r.skipped, r.error) for r in e.ingest(files).collect()}
    assert got == {"lease.txt": (True, None), "notes.txt": (False, None), "copy.txt": (False, None), "empty.txt": (False, "no extractable text")}
    assert all(r.skipped or r.error for r in e.ingest(files).collect())
    assert [r["name"] for r in e.documents().collect()] == ["copy.txt", "notes.txt"]
    e.refresh()
    lease = e.resolve("COPY")
    with pytest.raises(ValueError):
        e.resolve("txt")
    session = e.open_session()
    q = spark.createDataFrame([(1, "What is the monthly rent?"), (2, "Summarise this document"), (3, "what topics are covered"), (4, "Who won the football championship?")], "query_id bigint, question string")
    rows = {r.query_id: r for r in e.ask(q, session, [lease]).collect()}
    assert "48,500" in rows[1].answer and rows[2].intent == "summary" and "[S1]" in rows[2].answer
    assert rows[3].intent == "topics" and rows[3].answer.startswith("- ") and rows[4].refused
    with pytest.raises(ValueError):
        e.ask(spark.createDataFrame([(1, " ")], "query_id bigint, question string"))
    kept = e.messages(session).collect()
    assert [m.role for m in kept] == ["user", "assistant"] * 4 and kept[1].citations and kept[1].verdicts
    assert e.table("sessions").first().title == "What is the monthly rent?"
    e.rate(kept[1].message_id, 1)
    e.rate(kept[1].message_id, -1, "second")
    assert [(r.rating, r.note) for r in e.table("feedback").collect()] == [(-1, "second")]
    assert e.search("football").first().message_id
    told = e.explain(spark.createDataFrame([(1, "the security deposit")], "query_id bigint, topic string"), "exam", documents=[lease]).first()
    assert "2,91,000" in told.answer and told.intent == "lookup"
    with pytest.raises(ValueError):
        e.explain(spark.createDataFrame([(1, "rent")], "query_id bigint, topic string"), "poem")
    empty = e.open_session("empty")
    assert {(r.session_id, r.n_messages) for r in e.sessions().collect()} == {(session, 8), (empty, 0)}
    e.delete_message(kept[7].message_id)
    assert [m.seq for m in e.messages(session).collect()] == list(range(1, 8))
    e.delete_session(empty)
    e.delete_session(session)
    assert e.stats()["messages"] == e.stats()["sessions"] == e.table("citations").count() == e.table("feedback").count() == 0
    pack = e.study_pack([lease])
    assert pack["topics"].count() >= 1 and pack["flashcards"].count() >= 1
    made = {r.kind: r for r in pack["stats"].collect()}
    assert all(r.made == r.kept + r.rejected for r in made.values())
    for r in pack["short_answers"].collect():
        assert r.doc_id == lease and r.locator.startswith("p.1 L") and r.score >= 0.5
    e.delete(lease)
    assert e.stats()["registry"] == 1 and e.latest_document() is not None
    e.reset()
    assert e.stats()["registry"] == e.stats()["chunks"] == 0 and e.latest_document() is None


def test_command_line(spark, tmp_path, capsys):
    from citeframe.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lease.txt").write_text(LEASE)
    (tmp_path / "in" / "broken.txt").write_bytes(b"\xff\xfe")
    e = Engine(spark, str(tmp_path / "home"))
    main(["ingest", str(tmp_path / "in")], e)
    assert "lease.txt: 7 lines" in (said := capsys.readouterr().out) and "broken.txt: not a UTF-8 text" in said
    main(["ask", "What is the security deposit?", "--doc", "lease"], e)
    assert "2,91,000" in capsys.readouterr().out
    main(["topics", "lease"], e)
    assert capsys.readouterr().out.startswith("1. ")
    main(["docs"], e)
    main(["stats"], e)
    assert "registry 1" in capsys.readouterr().out
