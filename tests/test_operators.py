import pytest
from pyspark.sql import functions as F

from citeframe.operators import answer as A
from citeframe.operators import evaluate as E
from citeframe.operators import history as H
from citeframe.operators import index as I
from citeframe.operators import retrieve as R
from citeframe.operators import study as S
from citeframe.operators import understand as U
from citeframe.operators import verify as V
from citeframe.operators.chunking import chunks_of
from citeframe.plans.ask import Parts, ask
from citeframe.sources import lines as L

LEASE = "\n".join(
    [
        "CLAUSE 1 - RENT AND DEPOSIT",
        "The Tenant shall pay a monthly rent of Rs. 48,500 to the Landlord.",
        "The rent is payable in advance by the fifth day of each month.",
        "A refundable security deposit of Rs. 2,91,000 is held by the Landlord.",
        "CLAUSE 2 - TERMINATION",
        "Either party may terminate this lease by giving two months written notice.",
        "The Tenant shall pay Rs. 22,000 towards repainting on vacating the flat.",
    ]
)
NOTES = "UNIT 3 - NORMALIZATION\nA relation in Boyce Codd normal form has every determinant as a candidate key.\nThird normal form removes transitive dependencies from the relation schema."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LEASE), (2, NOTES), (3, None), (4, "")], "doc_id bigint, text string")


def test_lines_are_numbered_by_page(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(45)) + "\n\n  ")], "doc_id bigint, text string")
    rows = L.lines_of(df).orderBy("page_no", "line_no").collect()
    assert len(rows) == 45 and (rows[39].page_no, rows[39].line_no) == (1, 40) and (rows[40].page_no, rows[40].line_no) == (2, 1)


def plain_chunks(words, heads, target, overlap, least):
    """(start, end) of chunks of one page, from word counts and heading flags."""
    out, first, total, fresh = [], 0, 0, 0
    for i, w in enumerate(words):
        if heads[i] and total >= least:
            if fresh:
                out.append([first, i - 1])
            first, total, fresh = i, 0, 0
        total += w
        fresh += 1
        if total >= target:
            out.append([first, i])
            first = max(first, i - overlap + 1) if overlap else i + 1
            total, fresh = sum(words[first : i + 1]), 0
    if fresh:
        if total < least and out and out[-1][1] >= first - 1:
            out[-1][1] = len(words) - 1
        else:
            out.append([first, len(words) - 1])
    return [(a + 1, b + 1) for a, b in out]


def test_chunks_match_a_plain_loop(spark):
    import random

    r = random.Random(3)
    pages = [[(r.random() < 0.15, r.choice([1, 3, 8, 20, 60])) for _ in range(r.randint(1, 40))] for _ in range(60)]
    text = lambda page: "\n".join("SECTION " + "A " * (w - 1) if h else "word " * w for h, w in page)
    df = spark.createDataFrame([(i, text(p)) for i, p in enumerate(pages)], "doc_id bigint, text string")
    for overlap in (0, 2):
        got = {}
        for c in chunks_of(df, 25, overlap, 12).collect():
            got.setdefault(c.doc_id, []).append((c.line_start, c.line_end))
        heads = lambda p: [h and w <= 45 for h, w in p]  # noqa: E731  longer ones are no headings
        assert got == {i: plain_chunks([w for _, w in p], heads(p), 25, overlap, 12) for i, p in enumerate(pages)}


def test_chunk_text_is_its_lines(docs):
    lines = {(r.doc_id, r.page_no, r.line_no): r.text for r in L.lines_of(docs).collect()}
    for c in chunks_of(docs, 40, 1).collect():
        assert c.text == " ".join(lines[c.doc_id, c.page_no, n] for n in range(c.line_start, c.line_end + 1))
    with pytest.raises(ValueError):
        chunks_of(docs, 5)


def test_html(spark):
    html = "<html><head><style>p{}</style><script>x<1</script></head><body><h1>Top &amp; Title</h1><!-- no --><p>One<br>Two <b>bold</b></p></body></html>"
    rows = L.html_lines(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["Top & Title", "One", "Two bold"] and rows[0].section == "Top &amp; Title"


def test_reading_order(spark):
    rows = [(1, 1, 0, "b", 100.0, 10.2, 150.0, 20.2), (1, 1, 1, "a", 10.0, 10.0, 60.0, 20.0), (1, 1, 2, "c", 10.0, 40.0, 60.0, 50.0), (1, 1, 3, "  ", 0.0, 0.0, 1.0, 1.0)]
    got = L.positioned_lines(spark.createDataFrame(rows, "doc_id int, page_no int, ord int, text string, x0 double, y0 double, x1 double, y1 double")).orderBy("line_no").collect()
    assert [(r.text, r.row_span) for r in got] == [("a", 2), ("b", 2), ("c", 1)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_text("  ")
    got = {r.name: r.error for r in L.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": None, "b.txt": "not a UTF-8 text", "c.txt": "no extractable text"}


def test_bm25_prefers_the_rare_term(spark):
    units = spark.createDataFrame([(1, "rent rent flat"), (2, "flat garden"), (3, "flat roof"), (4, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "flat rent"), (2, "zebra"), (3, "")], "query_id bigint, text string")
    got = I.bm25_top_k(q, units).orderBy("query_id", "rank").collect()
    assert got[0].doc_id == 1 and {r.query_id for r in got} == {1}
    assert sorted(r.doc_id for r in got) == [1, 2, 3]


def test_hash_cosine_finds_itself(spark, docs):
    q = docs.where("doc_id <= 2").select(F.col("doc_id").alias("query_id"), "text")
    got = I.hash_cosine_top_k(q, docs, k=1).collect()
    assert {(r.query_id, r.doc_id, r.score) for r in got} == {(1, 1, 1.0), (2, 2, 1.0)}


def test_fusion(spark):
    kind = "query_id int, chunk_id string, score double, rank int"
    d = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], kind)
    x = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 4.0, 2)], kind)
    got = R.fuse(d, x, ["query_id"], "chunk_id").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[1].lexical_rank is None
    assert all(r.fused <= 2 / 61 for r in got)


def test_overlaps_are_dropped(spark):
    rows = [(1, 1, 1, 1, 10, 1), (1, 1, 1, 3, 10, 2), (1, 1, 1, 11, 20, 3), (1, 1, 2, 1, 10, 4), (1, 2, 1, 1, 10, 5), (1, 1, 1, 30, 40, 6)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, page_no int, line_start int, line_end int, rerank int")
    got = R.drop_overlaps(df).orderBy("position").collect()
    assert [(r.rerank, r.position) for r in got] == [(1, 1), (3, 2), (4, 3), (5, 4)]


def test_rerank_signals(spark):
    pool = spark.createDataFrame(
        [(1, 1, "monthly rent payable", "", "the monthly rent payable by the tenant", 0.5, 1), (1, 2, "monthly rent payable", "", "rent of a flat which is monthly and much later payable", 0.5, 2), (1, 3, "monthly rent payable", "", "", None, 3), (2, 1, "the of", "", "words", 0.1, 1)],
        "query_id int, doc_id int, question string, section string, text string, dense_score double, rank int",
    )
    got = {(r.query_id, r.doc_id): r for r in R.rerank(pool).collect()}
    assert got[1, 1].score > got[1, 2].score > got[1, 3].score == 0
    assert got[1, 1].window == 3 and got[1, 1].proximity == 1.0 and got[1, 1].phrase == pytest.approx(0.35 * 3 / 4)
    assert got[1, 2].window == 11 and got[2, 1].score == pytest.approx(0.015)


def test_variants(spark):
    q = spark.createDataFrame([(1, "What is the monthly rent for the flat?"), (2, "define bcnf"), (3, " "), (4, "rent rent deposit")], "query_id int, text string")
    got = {}
    for r in U.variants(q).orderBy("query_id", "variant_no").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got[1][:3] == ["What is the monthly rent for the flat", "monthly rent flat", "monthly rent for the flat is"]
    assert any("boyce codd normal form" in v for v in got[2]) and 3 not in got and "rent deposit" in got[4]


def test_spelling(spark):
    q = spark.createDataFrame([(1, "depsit amount"), (2, "rent is qqqqzzzz"), (3, "deposit")], "query_id int, text string")
    vocab = spark.createDataFrame([("deposit",), ("amount",), ("monthly",), ("depot",)], "word string")
    got = {r.query_id: r.spelling for r in U.repair_spelling(q, vocab).collect()}
    assert got == {1: "deposit amount", 2: "", 3: ""}


@pytest.mark.parametrize(
    ("text", "intent"),
    [
        ("summarise this document", "summary"),
        ("sumarize this documnt", "summary"),
        ("give me an overview", "summary"),
        ("explain this pdf", "summary"),
        ("explain abput this document", "summary"),
        ("what topics are covered", "topics"),
        ("list the sections", "topics"),
        ("explain BCNF in this document", "lookup"),
        ("What is the monthly rent?", "lookup"),
        ("", "lookup"),
    ],
)
def test_routing(spark, text, intent):
    assert U.route(spark.createDataFrame([(text,)], "text string")).first().intent == intent


def test_ask(spark, docs):
    q = spark.createDataFrame([(1, "What is the monthly rent?"), (2, "Who won the football championship?"), (3, "What is the security deposit?")], "query_id bigint, question string")
    done = ask(q, docs)
    got = {r.query_id: r for r in done.result.collect()}
    assert "48,500" in got[1].answer and "[S1]" in got[1].answer and not got[1].refused and got[1].groundedness > 0.8 and got[1].doc_id == 1
    assert got[2].refused and got[2].confidence == "refused"
    assert "2,91,000" in got[3].answer
    assert all(0 <= r.score <= 1 for r in done.verdicts.collect())
    assert ask(q, docs, allowed=spark.createDataFrame([(2,)], "doc_id bigint")).sources.where("doc_id <> 2").count() == 0


def test_questions_rank_below_statements(spark):
    s = spark.createDataFrame([(1, "why repeatable read permits phantom reads", 1, "", "Explain why Repeatable Read permits phantom reads. (5 marks) Repeatable Read permits phantom reads as ranges stay unlocked.", None)], "query_id int, question string, position int, section string, text string, expanded array<string>")
    best = A.sentence_scores(s).orderBy(F.col("score").desc()).first()
    assert best.sentence.endswith("stay unlocked.")


def test_sanitise(spark):
    df = spark.createDataFrame([("A [S9] b [S1, S2] .",)], "t string")
    assert df.select(A.sanitize(F.col("t"), F.lit(3)).alias("x")).first().x == "A b [S1][S2]."


def test_models_plug_in(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, question string")
    s = spark.createDataFrame([(1, 1, "text one"), (2, 1, "text two")], "query_id int, position int, text string")

    def fake(system, prompt):
        if "two" in prompt:
            raise RuntimeError("down")
        return "Answer from the model"

    rows = A.with_model(A.prompts(q, s), fake, "system").withColumn("n_sources", F.lit(1))
    plain = spark.createDataFrame([(1, "e1 [S1]"), (2, "e2 [S1]")], "query_id int, answer string")
    got = {r.query_id: r for r in A.finish_model_answer(rows, plain).collect()}
    assert got[1].answer == "Answer from the model [S1]" and got[2].answer == "e2 [S1]" and "down" in got[2].provider_error


def test_each_marker_is_narrowed_in_its_own_source(spark):
    cited = spark.createDataFrame([(1, 1, 10, 1, 1, 2, "rent is due monthly"), (1, 2, 20, 1, 5, 6, "deposit is refundable")], "query_id int, position int, doc_id int, page_no int, line_start int, line_end int, quote string")
    lines = spark.createDataFrame([(10, 1, 1, "rent is due monthly"), (10, 1, 2, "other"), (20, 1, 5, "other"), (20, 1, 6, "deposit is refundable")], "doc_id int, page_no int, line_no int, text string")
    answers = spark.createDataFrame([(1, "Rent is due monthly and deposit is refundable [S1][S2].")], "query_id int, answer string")
    v = V.verdicts(V.claims(answers), cited, V.source_lines(cited, lines))
    got = {r.position: (r.doc_id, r.first_line, r.last_line) for r in V.narrowed(v).collect()}
    assert got == {1: (10, 1, 1), 2: (20, 6, 6)}


def test_history(spark):
    kind = "session_id int, seq int, role string, content string"
    m = spark.createDataFrame([(1, 1, "user", "hello  there"), (1, 2, "assistant", "hi"), (1, 3, "user", "more"), (1, 4, "system", "note"), (2, 1, "assistant", "alone")], kind)
    assert {(r.user, r.reply) for r in H.pairs(m).collect()} == {("hello  there", "hi"), ("more", "note")}
    assert {r.session_id: r.title for r in H.sessions(m).collect()} == {1: "hello there", 2: H.DEFAULT_TITLE}
    assert H.delete_cascade(spark.createDataFrame([(1,)], "session_id int"), "session_id", m)[0].count() == 1
    f = "message_id int, rating int, note string, created_at int"
    up = H.upsert_feedback(spark.createDataFrame([(1, 1, "old", 1), (2, 1, "keep", 5)], f), spark.createDataFrame([(1, -1, "new", 2), (2, -1, "late", 3)], f))
    assert {r.message_id: r.note for r in up.collect()} == {1: "new", 2: "keep"}
    assert "**User:** hello  there" in H.export_markdown(m).where("session_id = 1").first().markdown
    assert H.stats(m.where("false")).first().messages == 0


@pytest.mark.parametrize(("s", "kind", "answer"), [("pays Rs. 48,500 now", "money", "Rs. 48,500"), ("six per cent a year", "percent", "six per cent"), ("on 3 March 2024", "date", "3 March 2024"), ("for eleven (11) months", "duration", "eleven (11) months"), ("room 204 only", "number", "204"), ("no facts here", None, None)])
def test_salient(spark, s, kind, answer):
    got = spark.createDataFrame([(s,)], "s string").select(S.salient(F.col("s")).alias("f")).first().f
    assert (got and got.kind, got and got.answer) == (kind, answer)


def test_cloze(spark):
    text = "\n".join(f"The charge for service number {w} in the schedule is Rs. {n} only." for w, n in (("one", 100), ("two", 250), ("three", 975), ("four", 4000)))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = S.cloze(S.salient_facts(df, "doc_id"), S.fact_pool(df), "doc_id").collect()
    assert len(got) == 4
    for r in got:
        assert S.BLANK in r.question and r.options[r.correct_index] == r.answer and len(set(r.options)) == 4


def test_topics(spark, docs):
    got = S.topics(chunks_of(docs, 40, 1), thin=5).where("doc_id = 1").orderBy("topic_no").collect()
    assert [r.name for r in got] == ["Rent And Deposit", "Termination"]


def test_metrics(spark):
    cases = spark.createDataFrame([("in", [False, True], False, False, 0.9, 10), ("in", [True], True, False, 0.2, 20), (E.OUT, [], True, True, 0.1, 30)], "category string, relevance array<boolean>, refused boolean, flagged boolean, best_score double, latency_ms int")
    r = E.ranking_metrics(cases).first()
    assert (r.n, r.recall_1, r.recall_3, r.mrr, r.precision_5) == (2, 0.5, 1.0, 0.75, 0.75)
    f = E.refusal_metrics(cases).first()
    assert (f.refusal_recall, f.refusal_precision, f.false_refusal_rate) == (1.0, 0.5, 0.5)
    t = E.latency_metrics(cases).first()
    assert (t.latency_p50, t.latency_p95, t.latency_max) == (20.0, 20.0, 30.0)
    assert E.calibration(cases).first().suggested_threshold == 0.15
    empty = cases.where("false")
    assert E.ranking_metrics(empty).first().n == 0 and E.refusal_metrics(empty).first().refusal_recall == 0.0


def test_streaming_ingest(spark, tmp_path):
    from citeframe.streaming.ingest import document_stream, ingest

    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, LEASE), (2, LEASE), (3, NOTES)], "doc_id bigint, text string").coalesce(1).write.parquet(folder)
    ingest(document_stream(spark, folder), target, str(tmp_path / "ck")).awaitTermination()
    n = spark.read.parquet(f"{target}/chunks").count()
    spark.createDataFrame([(9, NOTES)], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)
    ingest(document_stream(spark, folder), target, str(tmp_path / "ck")).awaitTermination()
    assert n > 0 and spark.read.parquet(f"{target}/chunks").count() == n
    assert {r.doc_id for r in spark.read.schema("doc_id bigint").parquet(f"{target}/registry").collect()} == {1, 3}


def test_parts_can_be_replaced(spark, docs):
    """A model's variants find what the question's own words do not; a reranker may turn the order round."""
    q = spark.createDataFrame([(1, "Which caution money is kept?")], "query_id bigint, question string")

    def backwards(pool, key):
        found = R.rerank(pool, key)
        return found.withColumn("rerank", (F.lit(100) - F.col("rerank")).cast("int"))

    parts = Parts(expand=lambda asked: asked.select("query_id", F.lit("refundable security deposit held by the Landlord").alias("text")))
    assert ask(q, docs, parts=parts).sources.where("doc_id = 1").count() > 0
    assert ask(q, docs, parts=Parts(reranker=backwards)).sources.count() == 0  # none is among the first


def test_hashed_rows_by_hand(spark):
    import hashlib

    text = "Rent deposits rent"
    features = ["rent", "deposits", "rent", "rent_deposits", "deposits_rent", "#depo", "#epos", "#posi", "#osit", "#sits"]
    wanted = {}
    for f in features:
        digest = hashlib.md5(f.encode()).hexdigest()
        b = int(digest[:15], 16) % 384
        wanted[b] = (wanted.get(b, (0,))[0] + 1, 1 if digest[15] in "02468ace" else -1)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: {t.bucket: (t.tf, t.sign) for t in r.terms} for r in I.hashed(df, ["doc_id"]).collect()}
    assert got == {1: wanted, 2: {}, 3: {}}
    assert I.hashed(df.where("false"), ["doc_id"]).count() == 0


def test_blocks_of_queries_agree(spark, docs):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["monthly rent", "normal form", "deposit", ""])], "query_id bigint, text string")
    whole, parts = (sorted(map(tuple, I.hash_cosine_top_k(q, docs, k=2, block_rows=n).collect())) for n in (4096, 1))
    assert whole == parts and {r[0] for r in whole} == {0, 1, 2}


def test_report_and_strict_gold(spark, docs):
    cases = spark.createDataFrame([("in_corpus", [False, True], True, True, 0.8, False, False, 0.9)], "category string, relevance array<boolean>, answer_hit boolean, citation_correct boolean, groundedness double, refused boolean, flagged boolean, best_score double")
    got = {r["name"]: r.value for r in E.report(cases).collect()}
    assert got["mrr"] == 0.5 and got["answer_accuracy"] == 1 and got["false_refusal_rate"] == 0 and got["in_corpus_min"] == 0.9
    gold = spark.createDataFrame([(1, "monthly rent"), (2, "no such phrase")], "item_id bigint, phrase string")
    with pytest.raises(ValueError, match="2"):
        E.require_gold(E.gold_in_corpus(gold, docs))
    E.require_gold(E.gold_in_corpus(gold.where("item_id = 1"), docs))


def test_locate_takes_the_best_chunk(spark, docs):
    chunks = chunks_of(docs.where("doc_id < 3"), 20, 0, 5)
    claim = "Either party may terminate this lease by giving two months written notice."
    claims = chunks.select(F.lit(7).alias("item"), F.lit(claim).alias("claim"), "chunk_id")
    r = S.locate(claims, chunks, L.lines_of(docs), "item").collect()
    assert len(r) == 1 and r[0].doc_id == 1 and r[0].first_line <= 6 <= r[0].last_line and r[0].score > 0.9


def test_bm25_makes_no_row_for_each_match(spark):
    """200 units that share one word with 200 questions: what is shuffled are the best of each batch, not the 40,000 matches."""
    units = spark.range(200).selectExpr("id as doc_id", "concat('common word', id, repeat(' filler', cast(id % 7 as int))) as text")
    q = spark.range(200).selectExpr("id as query_id", "concat('common word', id) as text")
    found = I.bm25_top_k(q, units, k=1)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(i, i) for i in range(200)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    parts = I.bm25_top_k(q, units, k=1, block_rows=50)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, found.collect()))


def test_bm25_of_texts_and_of_postings_agree(spark):
    texts = ["", None, "a b c a", "Rent, rent; the RENT of é1 x", "the the the deposit", "x" * 9 + " rent", "deposit rent the of a"]
    units = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame([(1, "the rent"), (2, "a a deposit"), (3, ""), (4, "nowhere"), (5, None)], "query_id int, text string")
    found, stored_ = (sorted(map(tuple, I.bm25_top_k(q, units, k=3, postings_of=p).collect())) for p in (None, I.sized_postings(units)))
    assert found == stored_ and {r[0] for r in found} == {1, 2}


def test_ask_shuffles_no_chunk_and_no_line(spark, docs, monkeypatch):
    """Chunks and lines meet small stored tables; the chunks made for a question set are deleted with it."""
    from citeframe.plans import ask as plan

    seen, dropped = {}, []
    monkeypatch.setattr(plan.V, "source_lines", lambda places, lines, f=plan.V.source_lines: seen.setdefault("lines", f(places, lines)))
    monkeypatch.setattr(plan, "forget", lambda df, f=plan.forget: (dropped.extend(df.inputFiles()), f(df)))
    ask(spark.createDataFrame([(1, "What is the monthly rent?")], "query_id bigint, question string"), docs)
    text = seen["lines"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text
    import os

    assert dropped and not any(os.path.exists(f.removeprefix("file://")) for f in dropped)


def test_locate_searches_promising_chunks_only(spark, monkeypatch):
    """A claim that one chunk holds is not searched in chunks that cannot score as high, whose bounds hold for every window."""
    from citeframe.functions.fuzzy import Claim, best_window

    docs = spark.createDataFrame([(1, "\n".join(f"Clause {i} says words{i} about matter{i} and other{i} things." for i in range(400)) + "\nThe deposit is 4,500 rupees and is due within 30 days.")], "doc_id bigint, text string")
    chunks = chunks_of(docs)
    claims = chunks.selectExpr("1 as item", "'The deposit is 4,500 rupees and is due within 30 days.' as claim", "chunk_id")
    pairs, searched = claims.count(), []
    monkeypatch.setattr(S, "stored", lambda df, f=S.stored: (searched.append(df), f(df))[1])
    r = S.locate(claims, chunks, L.lines_of(docs), "item").collect()
    bounds = next(d for d in searched if "bound" in d.columns).collect()
    first = next(d for d in searched if "score" in d.columns).first()
    assert len(r) == 1 and r[0].score == 1.0 and len(bounds) == pairs > 10
    assert sum(b.bound >= first.score - 1e-4 for b in bounds) == 1
    lines = [x.text for x in L.lines_of(docs).limit(40).collect()]
    for claim in (lines[3], "Clause 7 says 9 things", "nothing", ""):
        assert best_window(claim, lines)[0] <= Claim(claim).bound(" ".join(lines))


def test_fact_signs_hide_no_fact(spark):
    from citeframe.functions import constants as K

    texts = ["Rs ,", "rs. 5", "INR12", "$ 4", "₹7 00", "five PER  CENT", "20%", "ten percent", "5 MAY 2020", "May 2020", "two (2) Weeks", "3 hours", "one day", "in 42", "x", "7", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.when(F.length(F.trim(F.regexp_extract("t", p, 0))) >= 2, F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_extract("t", p, 0)).alias("answer"))) for k, p in K.FACTS])
    assert df.where(~S.salient(F.col("t")).eqNullSafe(plain)).count() == 0
