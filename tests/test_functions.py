"""Text, classification and number functions on small frames."""

import hashlib

import pytest
from pyspark.sql import functions as F

from memoglyph.functions import classify as C, numeric as N, text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(column.alias("v")).first()["v"]


def test_tokens(spark):
    t = "Hello the_World a.b x 你好 世 hello"
    assert one(spark, X.search_tokens("t"), t=t) == ["hello", "the_world", "a.b", "你好"]
    assert one(spark, X.ranking_tokens("t"), t="Café ok 你好吗 ok") == ["caf", "ok", "ok", "你", "你好", "好", "好吗", "吗"]
    assert one(spark, X.fingerprint_tokens("t"), t="An (old) house, the house-cat") == ["old", "house", "the", "house", "cat"]
    assert one(spark, X.coercion_tokens("t"), t="A b/c 你好 d") == ["b/c", "你好"]
    assert one(spark, X.token_estimate("t"), t="你好ab") == 5


def test_noise(spark):
    for t, want in (("", True), ("abc", True), ("System: x y", True), ("[Mon 3 pm] hi", True), ("a useful text", False), ("  exec FAILED again", True)):
        assert one(spark, X.is_noise("t"), t=t) is want


def test_redaction(spark):
    t = "mail a.b@c.org key: api_key=abcdefgh12 https://u:p@h.org card 1234-5678-9012-3456 ssn 123-45-6789 tel 555-123-4567 Bearer abcdefghij0123456789"
    got = one(spark, X.redact("t"), t=t)
    for name in ("EMAIL", "API_KEY", "URL_AUTH", "CREDIT_CARD", "SSN", "PHONE", "BEARER_TOKEN"):
        assert f"[REDACTED_{name}]" in got
    assert "[REDACTED_" not in one(spark, X.redact("t", "strict"), t=t)
    assert one(spark, X.redact_outbound("t"), t='password="secret99" https://u:p@host/x') == "password=[REDACTED] https://[REDACTED]@host/x"
    assert X.custom_pattern_is_safe("ab+c") and not X.custom_pattern_is_safe("(a+)+") and not X.custom_pattern_is_safe("(") and not X.custom_pattern_is_safe("x" * 201)
    assert one(spark, X.redact("t", custom=[("PET", "cat|dog")]), t="a dog here") == "a [REDACTED_PET] here"


def fnv(s):
    h = 0x811C9DC5
    for c in s:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("s", ["a", "hello world", "äöü", "你好", "😀x", "w:token/1"])
def test_fnv(spark, s):
    assert one(spark, X.fnv1a32("t"), t=s) == fnv(s)


def test_hash_embedding(spark):
    text = "Hello 你好吗 hello"
    features = one(spark, X.hash_features("t"), t=text)
    assert features[:5] == ["w:hello", "w:hello", "c:你好吗", "c2:你好", "c2:好吗"] and "c3:你好吗" in features and features[-1] == "g3:llo"
    assert one(spark, X.hash_features("t"), t="é") == ["raw:é"] and one(spark, X.hash_features("t"), t=" ") == []
    want = [0.0] * 32
    for f in features:
        h = fnv(f)
        want[h % 32] += 1.0 if h >> 1 & 1 == 0 else -1.0
    norm = sum(v * v for v in want) ** 0.5
    got = one(spark, N.hash_embedding(X.hash_features("t"), X.fnv1a32, 32), t=text)
    assert got == pytest.approx([round(v / norm, 8) for v in want], abs=1e-8)


def test_names(spark):
    assert one(spark, X.entity_id("t"), t="Ångström Über-Lab!") == "Ångström_Über_lab"
    assert one(spark, X.entity_id("t"), t="!!!") == "_unknown_"
    assert one(spark, X.safe_filename("t"), t=' a/b: "c" ') == "a_b_-_c_"
    assert one(spark, X.clamp_text("t", 8), t="abcdefghij") == "abcde..."
    assert one(spark, X.project_of(F.lit(""), "t"), t="/home/me/site/") == "site"
    assert one(spark, X.file_refs("t"), t="see src/a.py and b.json, not c.exe") == ["src/a.py", "b.json"]
    assert one(spark, X.record_id("t", F.lit(None), F.lit("b"), F.lit("c")), t="a") == hashlib.sha1(b"a||b|c").hexdigest()[:16]


def test_ladders(spark):
    assert one(spark, C.scope_of("t", F.lit("x")), t="user prefers short")["scope"] == "user"
    assert one(spark, C.scope_of("t", F.lit("x")), t="you must do it")["confidence"] == 0.72
    assert one(spark, C.scope_of("t", F.lit("openclaw")), t="the run ended")["scope"] == "task"
    assert one(spark, C.layer(F.lit(""), F.lit("Writeback "), F.lit(""))) == "durable"
    assert one(spark, C.tier_of(F.lit("durable"), F.lit(""), F.lit("project"))) == 3
    assert one(spark, C.freshness(F.lit(-1)), x=1) == "hot" and one(spark, C.freshness(F.lit(-1), "unknown"), x=1) == "unknown"
    assert C.intent_of("what is the latest") == "recent" and C.intent_of("x", scope="run") == "task" and C.intent_of("x", route="durable") == "durable"
    assert one(spark, C.query_type(F.col("t")), t="python docker api")["query_type"] == "keyword_heavy"
    assert one(spark, C.query_type(F.col("t")), t="how could i explain what the difference between these many things is?")["query_type"] == "semantic_heavy"
    assert one(spark, C.promotion_reason(F.lit("user"), F.lit("note"), F.lit("hook"), F.lit(""), F.lit(0.3), F.lit("x")))["reason"] == "low-confidence:0.30"


def test_numbers(spark):
    assert one(spark, N.decay(F.lit(30.0), 30.0)) == 0.5 and one(spark, N.decay(F.lit(-3.0), 30.0)) == 1.0 and one(spark, N.decay(F.lit(5.0), 0)) == 1.0
    assert one(spark, N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, N.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, N.iso_ms(F.lit("2024-02-01T00:00:00.000Z"))) == 1706745600000 and one(spark, N.iso_ms(F.lit("bad"))) is None
    assert one(spark, N.value_at(F.array(*(F.lit(i) for i in range(20))), 0.95)) == 19
