import re

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from langweave.functions import text as tx

# raw, normalised, valid, arabizi
VECTORS = [
    ("wach nta labas 3lik?", "wach nta labas \u0639lik?", True, True),
    ("a73 73a a77b 2024 7", "a\u062d3 7\u0639a a\u062d\u062db 2024 7", False, True),
    ("HTTP://X.y http://a.b/c?d @ali_9 www.z.ma fin", "http://x.y fin", True, True),
    (
        "\u0645\u064f\u062d\u064e\u0645\u064e\u0651\u062f @\u0645\u064f\u062d \u0625\u0644\u0649 "
        "\u0622\u062e\u0631\u0629 \u0640\u0640",
        "\u0645\u062d\u0645\u062f \u062d \u0627\u0644\u064a \u0627\u062e\u0631\u0647",
        True,
        False,
    ),
    ("a\xa0b\u2003c\x1cd\x85e\u200bf", "a b c d e\u200bf", True, True),
    ("\u0130STANBUL \u039f\u0394\u039f\u03a3 \xc9\xc0", "i\u0307stanbul \u03bf\u03b4\u03bf\u03c2 \xe9\xe0", True, True),
    ("mail a.b@c.d e", "mail a.b.d e", True, True),
    ("\u0663\u0664 ab", "\u0663\u0664 ab", True, False),
    ("12 34 5", "12 34 5", False, False),
    ("http://abc.de/xyz", "", True, True),
    ("\u0663\u0664", "\u0663\u0664", True, False),
    ("a1", "a1", False, True),
    ("ab 123", "ab 123", False, True),
    ("\u0627\u0628\u062c\u062f\u0647 ab3", "\u0627\u0628\u062c\u062f\u0647 ab\u0639", True, False),
    ("\u0627\u0628\u062c\u062f\u0647 abc", "\u0627\u0628\u062c\u062f\u0647 abc", True, False),
    ("\u0627\u0628\u062c\u062f ab3", "\u0627\u0628\u062c\u062f ab\u0639", True, True),
    ("\u0627\u0628 ab", "\u0627\u0628 ab", True, False),
    ("ab\u0627\u0628\u062c 3", "ab\u0627\u0628\u062c 3", True, False),
    ("\xa0", "", False, False),
    ("", "", False, False),
    (None, "", False, False),
]


def evaluate(spark, values, *columns):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", *columns)
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_edge_vectors(spark):
    out = evaluate(
        spark,
        [v[0] for v in VECTORS],
        tx.normalize_text(F.col("t")),
        tx.is_valid_text(F.col("t")),
        tx.is_arabizi(F.col("t")),
    )
    assert out == [v[1:] for v in VECTORS]


def test_options(spark):
    opts = tx.NormalizeOptions
    text = "Salam #tag @me \u0623b7 \U0001f44d\U0001f3fd http://x"
    cases = {
        opts(): "salam #tag \u0627b\u062d \U0001f44d\U0001f3fd",
        opts(rm_hashtags=True): "salam \u0627b\u062d \U0001f44d\U0001f3fd",
        opts(keep_emojis=False): "salam #tag \u0627b\u062d",
        opts(lowercase_latin=False): "Salam #tag \u0627b\u062d \U0001f44d\U0001f3fd",
        opts(rm_urls=False): "salam #tag \u0627b\u062d \U0001f44d\U0001f3fd http://x",
        opts(rm_mentions=False): "salam #tag @me \u0627b\u062d \U0001f44d\U0001f3fd",
        opts(norm_arabic=False): "salam #tag \u0623b\u062d \U0001f44d\U0001f3fd",
        opts(norm_arabizi=False): "salam #tag \u0627b7 \U0001f44d\U0001f3fd",
    }
    for option, expected in cases.items():
        assert evaluate(spark, [text], tx.normalize_text(F.col("t"), option)) == [(expected,)]


def test_emoji_sequences(spark):
    samples = [
        ("a\U0001f468\u200d\U0001f469\u200d\U0001f467b", "ab"),
        ("x\u2764\ufe0fy", "xy"),
        ("1\ufe0f\u20e3 1", " 1"),
        ("\U0001f1f2\U0001f1e6ok", "ok"),
        ("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f.", "."),
        ("plain 12 #x *", "plain 12 #x *"),
    ]
    out = evaluate(spark, [s[0] for s in samples], tx.remove_emojis(F.col("t")))
    assert [o[0] for o in out] == [s[1] for s in samples]


def test_emoji_ranges_are_unicode_emoji():
    ours = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), tx.EMOJI) + "]")
    theirs = regex.compile(r"\p{Emoji}")
    differing = [
        hex(cp)
        for cp in range(0x80, 0x20000)
        if bool(ours.match(chr(cp))) != bool(theirs.match(chr(cp)))
        and not 0x1FA70 <= cp <= 0x1FAFF  # these blocks still grow with each Unicode version
        and not 0x1F6D8 <= cp <= 0x1F6DC
    ]
    assert differing == []


def py_ratios(text):
    tokens = text.split()
    if not tokens:
        return (0.0, 0.0, 0.0)
    a = sum(any("\u0600" <= c <= "\u06ff" for c in t) for t in tokens) / len(tokens)
    b = sum(any(c.isascii() and c.isalpha() for c in t) for t in tokens) / len(tokens)
    return (a, b, min(a, b))


def py_arabizi(text):
    arab = sum("\u0600" <= c <= "\u06ff" for c in text)
    latin = sum(c.isascii() and c.isalpha() for c in text)
    if not arab + latin:
        return False
    share = latin / (arab + latin)
    mixed = any(
        any(c in "2378569" for c in t) and any(c.isascii() and c.isalpha() for c in t)
        for t in text.lower().split()
    )
    return share > 0.5 or (share > 0.3 and mixed)


ALPHABET = "ab7Z39 \t\u00a0\u2003\u0627\u0628\u0640\u064e\u0663.@#_\u00e9\u0130\u212a"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=25), min_size=20, max_size=40))
def test_against_python_on_random_text(spark, texts):
    out = evaluate(
        spark,
        texts,
        tx.tokenize_ws(F.col("t")),
        tx.script_ratios(F.col("t")),
        tx.is_arabizi(F.col("t")),
        tx.strip(F.col("t")),
    )
    for text, (tokens, ratios, arabizi, stripped) in zip(texts, out):
        assert tokens == text.split()
        assert tuple(ratios) == pytest.approx(py_ratios(text))
        assert arabizi == py_arabizi(text)
        assert stripped == text.strip()


def test_label_routing(spark):
    rows = [("AR_DAR", "arabizi"), ("AR_DAR", "arabic"), ("AR_DAR", None), ("FR", None)]
    df = spark.createDataFrame(rows, "l string, s string")
    out = [r[0] for r in df.select(tx.prompt_key(F.col("l"), F.col("s"))).collect()]
    assert out == ["AR_DAR_LAT", "AR_DAR_AR", "AR_DAR_AR", "FR"]
    scripts = df.select(tx.script_of_dialect(F.col("l"), F.col("s") == "arabizi")).collect()
    assert [r[0] for r in scripts] == ["arabizi", "arabic", "arabic", None]
