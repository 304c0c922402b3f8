"""Records that earlier versions got wrong: one small case for each."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicekit import session
from slicekit.config import FIXTURE, PILOT
from slicekit.operators import agree as G
from slicekit.operators import chrf as C
from slicekit.operators import enrich as E
from slicekit.operators import jobs as J
from slicekit.operators import mt as M
from slicekit.operators import parse as P
from slicekit.operators import prep
from slicekit.operators import reshape as R
from slicekit.operators import slices as S

TAGS = "struct<linguistic_phenomena:array<string>,paraphrase_distance:string,domain:string>"


def test_a_reply_with_two_objects_is_no_json(spark):
    replies = ['{"verdict":"correct"}', 'Sure: {"verdict":"correct"} bye', '{"verdict":"correct"} or {"verdict":"incorrect"}',
               '{"verdict":"correct"},{"verdict":"incorrect"}', '{"verdict":"correct"} }', "{'verdict':'correct'}",
               '{"verdict":"correct"}] x [{"a":1}', '{"verdict":"correct","more":{"a":[1,{"b":2}]}}']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [(r.status, r.correct) for r in P.parse_judgements(df).orderBy("i").collect()]
    assert got == [("ok", True), ("ok", True), *[("error", None)] * 5, ("ok", True)]


def test_domains_and_phenomena_of_other_languages_are_not_reported(spark):
    rows = [("a", "id", "indoqa", (["voice_di"], "paraphrase", "general")), ("b", "sw", "squad_sw", (["passive"], None, "general"))]
    items = spark.createDataFrame(rows, f"id string, lang string, dataset string, tags {TAGS}")
    cov = S.coverage(items, PILOT)
    by = {r.dataset: r for r in cov.collect()}
    assert by["indoqa"].dom_indonesian_history == 0 and by["indoqa"].dom_east_african_history is None
    assert by["indoqa"].ph_passive is None and by["squad_sw"].ph_passive == 1
    long = S.coverage_pct(cov, PILOT).collect()
    assert {r.value for r in long if r.dataset == "indoqa" and r.facet == "domain"} == set(PILOT.lang("id").domains)
    assert {r.value for r in long if r.dataset == "squad_sw" and r.facet == "phenomenon"} == {*PILOT.lang("sw").phenomena, "none"}


def test_local_share_ignores_domains_of_other_languages(spark):
    from slicekit.operators import compare as X
    tag = lambda d: ([], None, d)
    rows = [("a", "sw", "tydiqa_sw", tag("east_african_history")), ("b", "sw", "tydiqa_sw", tag("general")),
            ("c", "sw", "squad_sw", tag("general"))]
    cov = S.coverage(spark.createDataFrame(rows, f"id string, lang string, dataset string, tags {TAGS}"), PILOT)
    assert [(r.lang, r.native_pct, r.translated_pct) for r in X.local_share(cov, PILOT).collect()] == [("sw", 50.0, 0.0)]


def test_pairs_that_share_a_key_are_scored_each(spark):
    pairs = [("k", "same text", "same text"), ("k", "xyzw", "abcd"), ("d", "ab cd", "ab ce"), ("d", "ab cd", "ab ce"), ("e", "", "ref")]
    got = C.chrf_sentence(spark.createDataFrame(pairs, "id string, hyp string, ref string"), ["id"]).collect()
    assert sorted(round(r.chrf, 6) for r in got if r.id == "k") == [0.0, 100.0]
    twice = [r.chrf for r in got if r.id == "d"]
    assert len(twice) == 2 and twice[0] == twice[1] and len(got) == 4
    alone = C.chrf_sentence(spark.createDataFrame(pairs[2:3], "id string, hyp string, ref string"), ["id"]).first().chrf
    assert twice[0] == alone


def test_merging_takes_the_last_of_equal_ids(spark):
    cols = "id string, dataset string, gold string"
    fresh = spark.createDataFrame([("a", "x", "new"), ("b", "x", "new")], cols)
    old = spark.createDataFrame([("a", "x", "1", 1), ("a", "x", "2", 2), ("c", "x", "9", 1), ("c", "x", "8", 3), ("z", "no", "1", 1)], cols + ", n int")
    got = prep.merge_existing(fresh, old, ["x"], order="n")
    assert sorted((r.id, r.gold) for r in got.collect()) == [("a", "2"), ("b", "new"), ("c", "8")]
    assert prep.merge_existing(fresh, old.drop("n"), ["x"]).count() == 3


def test_an_upsert_gives_one_row_for_each_key(spark):
    cols = "id string, verdict string, status string, error string, n int"
    old = spark.createDataFrame([("a", "old", "ok", None, 1), ("a", "older", "ok", None, 0), ("b", "old", "ok", None, 1)], cols)
    new = spark.createDataFrame([("a", "good", "ok", None, 1), ("a", None, "error", "late", 2), ("b", None, "error", "x", 1),
                                 ("c", "1", "ok", None, 1), ("c", "2", "ok", None, 2)], cols)
    got = {r.id: (r.verdict, r.status, r.error) for r in J.upsert(old, new, ["id"], ["verdict"], order="n").collect()}
    assert got == {"a": ("good", "ok", None), "b": ("old", "ok", "x"), "c": ("2", "ok", None)}
    assert J.upsert(old, new, ["id"], ["verdict"]).count() == 3


def test_an_answered_rating_without_a_value_is_not_asked_again(spark):
    tr = spark.createDataFrame([("a", "m", "x"), ("b", "m", "x"), ("c", "m", "x"), ("d", "m", "")], "id string, model string, hyp string")
    sc = spark.createDataFrame([("a", "m", 4, "ok"), ("b", "m", None, "ok"), ("c", "m", None, "error")], "id string, model string, adequacy int, status string")
    assert [r.id for r in J.pending_metric(tr, sc, "adequacy", status="status").collect()] == ["c"]
    assert sorted(r.id for r in J.pending_metric(tr, sc, "adequacy").collect()) == ["b", "c"]


def _cells(spark, rows):
    return spark.createDataFrame([(i, lg, d, m, c, ok, None) for i, lg, d, m, c, ok in rows],
                                 f"id string, lang string, dataset string, model string, condition string, correct boolean, tags {TAGS}")


def test_reports_follow_the_order_of_the_config(spark):
    m = PILOT.models
    flat = R.flatten_all(_cells(spark, [("1", "sw", "squad_sw", m[1], "openbook", True), ("2", "sw", "tydiqa_sw", m[0], "closedbook", False),
                                        ("3", "id", "squad_id", m[0], "openbook", True)]), None, PILOT)
    got = [(r.dataset, r.model) for r in S.open_vs_closed(flat, PILOT, spark).collect()]
    assert got == [(d, x) for d in PILOT.datasets for x in m]
    d = S.disentangle(flat, PILOT, spark).collect()
    assert sorted((r.lang, r.model) for r in d) == sorted(("sw", x) for x in m)
    assert {r.model: (r.n, r.closed_acc) for r in d}[m[0]] == (0, 0.0)
    mt = spark.createDataFrame([("1", lg, x, [], 50.0) for lg in ("fr", "sw", "id") for x in reversed(m)],
                               "id string, lang string, model string, phenomena array<string>, chrf double")
    assert [(r.lang, r.model) for r in M.system_level(mt, PILOT, ("chrf",)).collect()] == [(lg, x) for lg in ("id", "sw", "fr") for x in m]


def test_a_language_with_translations_only(spark):
    spec = PILOT.lang("fr")
    assert spec.native_dataset is None and None not in PILOT.datasets
    rows = [(f"{k}", "fr", x, [p] if k % 2 else ["none"], float(k)) for k in range(8) for x in PILOT.models for p in spec.required[:1]]
    flat = spark.createDataFrame(rows, "id string, lang string, model string, phenomena array<string>, chrf double")
    got = M.per_tag(flat, PILOT, ("chrf",)).collect()
    assert sorted((r.phenomenon, r.model) for r in got) == sorted((p, m) for p in spec.required for m in PILOT.models)
    qa = R.flatten_all(_cells(spark, [("1", "id", "indoqa", PILOT.models[0], "openbook", True)]), None, PILOT)
    assert [r.lang for r in S.present_langs(qa, PILOT).collect()] == ["id"]
    assert S.accuracy_by_benchmark(qa, PILOT).count() == 1 and S.tagged_counts(_items(spark), PILOT, spark).count() == 4


def _items(spark):
    return spark.createDataFrame([("a", "id", "indoqa", "q", "c", "g", None), ("b", "sw", "squad_sw", "q", "c", "g", None)],
                                 f"id string, lang string, dataset string, question string, context string, gold string, tags {TAGS}")


def test_inspection_lists_every_model(spark):
    cells = spark.createDataFrame([("a", "m1", "openbook", "p", "correct", "", True)],
                                  "id string, model string, condition string, prediction string, verdict string, reason string, correct boolean")
    got = {r.id: r for r in R.slim_items(_items(spark), cells, FIXTURE).collect()}
    for r in got.values():
        assert [e.model for e in r.openbook] == list(FIXTURE.models)
    assert got["a"].correct_models == ["m1"] and got["a"].openbook[0].verdict is None and got["b"].n_correct == 0


def test_user_functions_see_none_and_integers_and_whole_errors(spark):
    seen = lambda rec: {"kind": type(rec["n"]).__name__}
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 2 ** 60 + 1)], "id string, n long").coalesce(1)
    assert sorted((r.id, r.kind) for r in E.enrich_missing(df, seen, "kind string", ["id"]).collect()) == [
        ("a", "int"), ("b", "NoneType"), ("c", "int")]

    def fails(rec):
        raise ValueError("x" * 3000)

    assert {len(r.error) for r in E.enrich_missing(df, fails, "kind string", ["id"]).collect()} == {3000 + len("ValueError: ")}


def test_no_function_runs_twice_for_a_row(spark, tmp_path):
    def called(name):
        def fn(rec):
            (tmp_path / f"{name}-{rec['id']}-{uuid.uuid4().hex}").touch()
            return {"question": "q", "context": "c d", "gold": "c", "span_found": True}
        return fn

    rows = spark.createDataFrame([(str(i), "t") for i in range(4)], "id string, text string")
    got = E.translate_and_locate(rows, called("translate"), called("locate"), "id")
    assert got.count() == 4 and got.filter("span_found").count() == 4 and len(got.collect()) == 4
    names = sorted("-".join(p.name.split("-")[:2]) for p in tmp_path.iterdir())
    assert names == sorted(f"{n}-{i}" for n in ("translate", "locate") for i in range(4))


def test_scratch_needs_a_shared_folder_off_local_masters():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7, 30, 31, 500, 501, 5000, 19_999, 20_003, 100_000])
@pytest.mark.parametrize("r", [0.001, 0.05, 0.3, -0.9, 0.999])
def test_p_values_equal_a_ratio_of_integrals(n, r):
    x, w = np.polynomial.legendre.leggauss(200)

    def integral(lo, parts=50):
        h = (math.pi / 2 - lo) / parts / 2
        return sum(h * float(np.sum(w * np.exp((n - 3) * np.log(np.cos(lo + h * (2 * j + 1 + x)))))) for j in range(parts))

    want = integral(math.asin(abs(r))) / integral(0.0)
    assert G.pearson_p_value(r, n) == pytest.approx(want, rel=1e-6 if n > 20_000 else 1e-9, abs=1e-250)


def test_ratings_as_text(spark):
    df = spark.createDataFrame([(1, '{"adequacy": "4", "fluency": 5, "note": "n"}'), (2, "no"), (3, '{"adequacy": null}')], "i int, reply string")
    got = [(r.adequacy, r.fluency, r.status) for r in P.parse_ratings(df).orderBy("i").collect()]
    assert got == [(4, 5, "ok"), (None, None, "error"), (None, None, "ok")]
    assert P.RATING_SCHEMA["adequacy"].dataType == T.StringType()
