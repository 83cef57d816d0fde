"""Random keys of any alphabet and length, and secrets that occur twice."""

import random
import re
import string
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from citeframe.llm import secrets
from llm_plain import plain_base

PROSE = "the service reads its settings at the start and writes a line for every request it answers. " * 8


@pytest.mark.parametrize(
    ("alphabet", "lengths"),
    [
        ("0123456789ABCDEF", (24, 64, 128, 400, 3000)),
        (string.ascii_uppercase + "234567", (32, 160, 800, 3000)),
        (string.ascii_lowercase + string.digits, (32, 200, 1000, 3000)),
        (string.ascii_letters + string.digits + "+/", (40, 600, 1000, 3000)),
    ],
)
def test_random_keys(alphabet, lengths):
    r = random.Random(12)
    for n in lengths:
        for _ in range(20):
            key = "".join(r.choice(alphabet) for _ in range(n - 2)).replace("AKIA", "AKIB") + ("7A" if "A" in alphabet else "7a")
            text = f"{PROSE}private key: {key} {PROSE}"
            assert (text.index(key), 3, text.index(key) + n) in secrets.scan(text)[1], (n, key)


def test_compounds_of_words_are_not_novel():
    r = random.Random(13)
    vocabulary = sorted({w for w in secrets.IDENTIFIERS.split() if w.isalpha() and w.islower() and len(w) < 14})
    for n in (30, 60):
        for _ in range(20):
            assert secrets.scan(f"{PROSE}the key is {'_'.join(r.choice(vocabulary) for _ in range(n))}_v2 of it")[1] == []


def test_repeated_secrets():
    key = "qX7pL0zR9vT2mK8wYbN4"
    text = f"Authorization: Bearer {key} and again\nAuthorization: Bearer {key} and\nprivate_auth: x={key} end {PROSE}"
    assert [text[a:b] for a, _, b in secrets.scan(text)[1]] == [key, key, f"x={key}"]
    assert key not in secrets.redact_text(text)
    apart = f"Bearer {key} " + "y z " * 247 + f"Bearer {key} end"
    assert len(secrets.scan(apart)[1]) == 2


def plain_scan(text):
    """Base and novel spans by looking at every candidate and every pair."""
    base = plain_base(text)
    runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_.=-]{16,}", text)]
    open_ = []
    for a, b in runs:
        line = text[max(0, a - 48) : a].split("\n")[-1]
        if re.search("[0-9]", text[a:b]) and re.search("[A-Za-z]", text[a:b]) and re.search("(?i)pass|pwd|secret|token|key|auth|cred|bearer|private|session|signature|salt|login|access", line):
            if not [1 for x, _, y in base if x < b and a < y]:
                open_.append((a, b))
    novel = []
    for a, b in open_:
        parts = text[a:b].split("=")
        value = max(parts, key=len) if max(map(len, parts)) >= 16 else text[a:b]
        before, behind = text[max(0, a - 1000 - len(value)) : a].replace(value, " ")[-1000:], text[b : b + 1000 + len(value)].replace(value, " ")[:1000]
        primed = zstandard.ZstdCompressionDict((secrets.IDENTIFIERS + "\n" + before + behind).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes = [len(zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x)) for x in (text[a:b].encode(), b"")]
        if (sizes[0] - sizes[1]) / (b - a) >= min(0.8, secrets.bound(text[a:b])):
            novel.append(value)
    return sorted(base + [(a, 3, b) for a, b in open_ if [v for v in novel if v in text[a:b]]])


def test_spans_by_brute_force():
    r = random.Random(22)
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(16, 40))) for _ in range(12)]
    parts = ["Bearer ", "the key ", "x=", " and ", "\n", "configuration_settings_v1", "password=", "AKIA" + "Z9" * 10, "0f" * 14, "session_id_1 ", *keys]
    novel = 0
    for _ in range(1500):
        text = "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 14)))
        got = secrets.scan(text)[1]
        assert got == plain_scan(text), text
        novel += any(k == 3 for _, k, _ in got)
    assert novel > 200


def test_many_spans_are_linear():
    """Base spans and candidates in a text of a megabyte."""
    r = random.Random(23)
    text = " ".join(f"token={r.getrandbits(64):x} key {''.join(r.choice(string.ascii_letters + string.digits) for _ in range(24))}" for _ in range(16_000))
    start = time.time()
    assert len(secrets.scan(text)[1]) > 30_000
    assert time.time() - start < 30


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "token=abcdef123", None)], "doc_id bigint, text string, spans string").withColumn("n_assign", F.lit("clash"))
    assert sorted((str(x.doc_id), x.n_assign, x.spans) for x in secrets.find_secrets(df).collect()) == [("1", 0, ""), ("1", 0, ""), ("2", 1, "assign:0:15"), ("None", 0, "")]
    assert secrets.find_secrets(df.where("false")).collect() == []
    assert sorted(map(str, secrets.redact(df).collect())) == sorted(map(str, df.withColumn("text", F.expr("if(doc_id = 2, '[REDACTED]', text)")).collect()))
