"""Reply parsing and Python string semantics on the JVM."""


from slicekit.functions.text import remove_whitespace, ustrip
from slicekit.operators import parse as PA


def test_extract_json_cases(spark):
    rows = [(1, '{"verdict": "correct", "reason": "ok"}'),
            (2, '```json\n{"verdict": "incorrect"}\n```'),
            (3, 'Sure! {"verdict": "correct", "reason": "x"} hope that helps'),
            (4, "no json here"),
            (5, "{broken}"),
            (6, "{'verdict': 'correct'}"),
            (7, '{"reason": "no verdict"}'),
            (8, None)]
    df = spark.createDataFrame(rows, "k int, reply string")
    got = {r.k: r for r in PA.parse_judgements(df).collect()}
    assert got[1].correct is True and got[1].reason == "ok"
    assert got[2].correct is False and got[2].reason == ""
    assert got[3].correct is True
    assert got[4].error == "no JSON object" and got[4].correct is None
    assert got[5].error == "invalid JSON"
    assert got[6].error == "invalid JSON"  # single quotes are not JSON
    assert got[7].error == "missing verdict" and got[7].status == "error"
    assert got[8].error == "no JSON object"


def test_ratings_as_text_are_cast(spark):
    df = spark.createDataFrame([(1, '{"adequacy": "5", "fluency": 4, "note": "fine"}'),
                                (2, '{"adequacy": "five"}')], "k int, reply string")
    got = {r.k: r for r in PA.parse_ratings(df).collect()}
    assert (got[1].adequacy, got[1].fluency, got[1].judge_note) == (5, 4, "fine")
    assert got[2].adequacy is None and got[2].status == "ok"


def test_strip_and_whitespace_match_python(spark):
    texts = ["  a b  ", " x　", "\tq\n", "\x1cz\x1f", " mid dle ", "", "​keep​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", ustrip("t").alias("s"), remove_whitespace("t").alias("w")).collect()
    for r in got:
        assert r.s == r.t.strip(), repr(r.t)
        assert r.w == "".join(r.t.split()), repr(r.t)


def test_brace_span_is_linear_and_matches_find_rfind(spark):
    import time
    texts = ["{" * 100000 + "x", "a}b{c}d", "}{", "{}", "pre {\"k\": 1} post } tail", "no braces"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t0 = time.perf_counter()
    got = {r.i: r.s for r in df.select("i", PA.json_object_text("t").alias("s")).collect()}
    assert time.perf_counter() - t0 < 30
    for i, t in enumerate(texts):
        a, b = t.find("{"), t.rfind("}")
        exp = t[a:b + 1] if a != -1 and b != -1 and b > a else ""
        assert got[i] == exp, t[:20]
