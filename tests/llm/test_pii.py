import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pulseframe.llm import pii
from tests.llm.helpers import base_pii

find = pii.Finder().spans
ALPHABET = "aZ09@@..--+ +%_()é/\n4111"


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_base_spans_equal_the_expressions(text):
    got = find(text)
    assert sorted((k, s) for k in pii.BASE for s in got[k]) == sorted(base_pii(text))


def test_known_cases():
    text = "Mail a.b+c@x-y.example.org, call +1 (555) 010-9999, pay 4111 1111 1111 1111 from 10.0.0.255 or 10.0.0.256"
    got = find(text)
    assert [text[a:b] for a, b in got["email"]] == ["a.b+c@x-y.example.org"]
    assert [text[a:b] for a, b in got["phone"]] == ["+1 (555) 010-9999"]
    assert [text[a:b] for a, b in got["card"]] == ["4111 1111 1111 1111"]
    assert [text[a:b] for a, b in got["ip"]] == ["10.0.0.255"]
    more = find("IBAN: GB82 WEST 1234 5698 7654 32; see https://joe:pw@example.com/x and http://example.com/x. Account number 12345678.")
    assert len(more["account"]) == 2 and len(more["url"]) == 1


def test_accounts_and_secrets():
    told = lambda text, kind: [text[a:b] for a, b in find(text)[kind]]
    assert told("to DE89370400440532013000, not DE88370400440532013000 or XDE89370400440532013000", "account") == ["DE89370400440532013000"]
    assert told("GB82 WEST 1234 5698 7654 32 AND MORE", "account") == ["GB82 WEST 1234 5698 7654 32"]
    assert told("CUSTOMER ID: 123456; Account Id 99-88-77 and aCcT# AB1234567", "account") == ["123456", "99-88-77", "AB1234567"]
    long = " ".join("1234" for _ in range(7))
    assert told(f"passport number {long}", "account") == [long] and told(f"ssn {long} 5678", "account") == [] and told("acct 12345", "account") == []
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert told(f'token = "{key}" or API_KEY:{key[:16]}, Password=short1 token {key} secret: abcdefghijklmnopqrstuv', "secret") == [key, key[:16]]
    odd = "\u0130\u212a é ACCT 1234567"  # lower case of the first has two characters
    assert told(odd, "account") == ["1234567"]


def test_query_equals_the_expressions(spark, tmp_path):
    draw = random.Random(6)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(90))) for _ in range(150)] + [None, "", "x" * 200_000 + " a@b.cc", "acct 1234567 a@b.cc"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op9_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        spans = sorted(base_pii(text), key=lambda s: (pii.BASE.index(s[0]), s[1]))
        line = ",".join(f"{k}:{a}:{b}" for k, (a, b) in spans)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(k == own for own, _ in spans) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line) and r.n_found == len([x for x in r.spans.split(",") if x])
    assert rows[-1].spans == "email:13:19,account:5:12"


def test_long_texts_take_linear_time():
    draw = random.Random(2)
    for text in ("1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "a@b." * 50_000, "SSN1 " * 40_000, "AB12 " * 40_000, "token=" * 40_000, "".join(draw.choice(ALPHABET) for _ in range(200_000))):
        got = find(text)
        if len(set(text)) > 4:
            assert sorted((k, s) for k in pii.BASE for s in got[k]) == sorted(base_pii(text))


def test_tables(spark):
    rows = [(1, "x@y.zz", None), (1, "x@y.zz", None), (2, None, "k"), (None, "", "k")]
    found, name = pii.annotate(spark.createDataFrame(rows, "doc_id long, text string, pii string"))
    assert name == "_pii"
    assert sorted(len(r[name]) for r in found.collect()) == [0, 0, 1, 1]
    assert pii.annotate(spark.createDataFrame([], "text string"))[0].collect() == []
