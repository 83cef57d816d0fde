import random

import pytest
from pyspark.sql import functions as F

from citeframe.functions import fuzzy
from citeframe.functions import text as X
from citeframe.functions.sentences import split_sentences
from citeframe.functions.unicode import fold_punctuation


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("CLAUSE 1 - RENT AND DEPOSIT", True),
        ("3.1 GENERAL PROVISIONS", True),
        ("Schedule of payments", True),
        ("UNIT 3 - NORMALIZATION", True),
        ("2. The tenant shall pay the rent.", False),
        ("an ordinary line of text", False),
        ("ab", False),
        ("X" * 121, False),
        ("Section 4 applies;", False),
        (None, False),
    ],
)
def test_headings(spark, line, wanted):
    assert one(spark, X.is_heading, line) is wanted


def test_normalise_line(spark):
    assert one(spark, X.normalise_line, " soft­hyphen \t and  space\r") == "softhyphen and space"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("see [S2] and [3, 1].", [2, 3, 1]), ("[S1; S2] [S1/2]", [1, 2]), ("[ s4 ]", [4]), ("none", []), (None, [])],
)
def test_parse_markers(spark, text, wanted):
    assert one(spark, X.parse_markers, text) == wanted


def test_markers_move_before_the_stop(spark):
    assert "[S2]." in one(spark, X.attach_trailing_markers, "The rent is Rs. 48,500. [S2] It is due. [S1]")
    assert one(spark, X.strip_markers, "a [S1] b [2]") == "a b"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Paid Rs. 500 to R. Sharma v. State. Done now.", ["Paid Rs. 500 to R. Sharma v. State.", "Done now."]),
        ('He said "stop." Then left.', ['He said "stop.', "Then left."]),
        ("Intro • first item • second item", ["Intro", "first item", "second item"]),
        ("", []),
        (None, []),
        ("ab", []),
    ],
)
def test_sentences(spark, text, wanted):
    assert one(spark, split_sentences, text) == wanted


def test_numbers_ignore_separators(spark):
    assert one(spark, X.numbers, "Rs. 1,00,000 or 100000 and 4.5.") == ["100000", "4.5"]


def test_folding(spark):
    assert one(spark, fold_punctuation, "lock‑in “x” months’ a b … ﬁ") == 'lock-in "x" months\' a b ... fi'
    assert one(spark, X.contains_phrase, "The  LOCK‑IN period", "lock-in period") is True
    assert one(spark, X.contains_phrase, "anything", "  ") is False
    assert one(spark, X.contains_phrase, "the ﬁnal oﬀer of ２０ ㎏", "FINAL offer of 20 kg") is True
    assert one(spark, X.contains_phrase, "café", "cafe\u0301") is True


def test_query_normalisation(spark):
    assert one(spark, X.normalise_query, "  What   is rent?! ") == "What is rent"
    assert one(spark, X.normalise_query, "???") == "???"


def test_features(spark):
    got = one(spark, lambda c: X.ngram_features(X.tokens(c)), "Rent deposit")
    assert got == ["rent", "deposit", "rent_deposit", "#depo", "#epos", "#posi", "#osit"]
    assert one(spark, lambda c: X.ngram_features(X.tokens(c)), None) == []


@pytest.mark.parametrize(
    ("reply", "n"),
    [('[{"q": "a"}, {"q": "b"}]', 2), ('```json\n[{"q": "a"}]\n```', 1), ('Sure: [{"q": "a"}] done', 1), ('{"questions": [{"q": "a"}, {"q": "b"}]}', 2), ('{"q": "a"}', 1), ("junk", 0), (None, 0)],
)
def test_json_repair(spark, reply, n):
    assert len(one(spark, lambda c: X.json_rows(c, "q string"), reply)) == n


def test_names_and_places(spark):
    assert one(spark, X.topic_name, "CLAUSE 2 - RENT AND PAYMENT") == "Rent And Payment"
    assert one(spark, lambda a: X.locator(F.lit(2), F.lit(14), F.lit(17)), "x") == "p.2 L14-17"
    assert one(spark, X.body_text, "HEAD: the body", "HEAD") == "the body"


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_fuzzy_scores():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.choice([0, 1, 4, 20, 70]))) for _ in "ab")
        assert fuzzy.lcs(a, b) == plain_lcs(a, b)
        short, long = sorted((a, b), key=len)
        wanted = max((fuzzy.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))), default=0.0) if short else (0.0 if long else 100.0)
        assert fuzzy.partial_ratio(a, b) == pytest.approx(wanted)
    assert fuzzy.ratio("depsit", "deposit") == pytest.approx(100 * 12 / 13)
    assert fuzzy.token_set_ratio("rent due", "due rent now") == 100.0
    assert fuzzy.token_set_ratio("", "x") == 0.0


def test_support():
    line = "The monthly rent is Rs. 48,500 payable in advance."
    assert fuzzy.Claim(line).support(line) > 0.95
    assert fuzzy.Claim("Photosynthesis requires chlorophyll").support(line) < 0.3
    assert fuzzy.Claim("rent is 48,500").support(line) > fuzzy.Claim("rent is 99,999").support(line)
    assert fuzzy.Claim("amount 100000").support("amount 1,00,000") > 0.5
    assert fuzzy.Claim("the of").support(line) == 0.0


def test_best_window():
    lines = ["heading one", "the tenant shall pay", "the monthly rent in advance", "by the fifth day", "unrelated closing words"]
    assert fuzzy.best_window("the monthly rent in advance", lines)[1:] == (2, 2)
    score, lo, hi = fuzzy.best_window("tenant shall pay the monthly rent in advance by the fifth day", lines)
    assert (lo, hi) == (1, 3) and score > 0.9
    assert fuzzy.best_window("x", []) == (0.0, -1, -1)


def test_sentences_keep_leading_digits(spark):
    rows = spark.createDataFrame([("One stands first. 1 apple falls here. 2 pears fall too, says Dr.",)], "t string")
    assert rows.select(split_sentences(F.col("t"))).first()[0] == ["One stands first.", "1 apple falls here.", "2 pears fall too, says Dr."]
