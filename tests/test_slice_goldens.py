"""All published open-book phenomenon slices (60 rows) rebuilt from counts.

For each (dataset, phenomenon) the number of items with the tag comes from the
published coverage report; per model exactly one integer k_with gives the
published with-accuracy, and k_without = k_total - k_with then gives the
published without-accuracy.  The engine must print every row.
"""

import numpy as np
from pyspark.sql import functions as F

from slicekit.config import EvalConfig, LangSpec
from slicekit.operators import reshape as R
from slicekit.operators import slices as S

MODELS = ("deepseek_v4_pro", "gemini_3_pro", "gemma_4_31b_it", "llama_31_8b")
# Items per dataset and open-book correct counts per model.
N = {"indoqa": 500, "squad_id": 499, "tydiqa_sw": 496, "squad_sw": 498}
K = {"indoqa": (466, 473, 475, 441), "squad_id": (464, 466, 465, 426),
     "tydiqa_sw": (419, 441, 427, 361), "squad_sw": (461, 466, 466, 356)}
# Fixed values: (dataset, phenomenon, n_with, [(no, has, delta) per model]).
SLICES = [
    ("indoqa", "voice_meN", 39, [(92.8, 97.4, 4.6), (94.4, 97.4, 3.0), (94.8, 97.4, 2.6), (87.6, 94.9, 7.3)]),
    ("indoqa", "voice_di", 74, [(93.2, 93.2, 0.0), (94.4, 95.9, 1.5), (94.8, 95.9, 1.1), (88.3, 87.8, -0.5)]),
    ("indoqa", "reduplication", 6, [(93.1, 100.0, 6.9), (94.5, 100.0, 5.5), (94.9, 100.0, 5.1), (88.1, 100.0, 11.9)]),
    ("indoqa", "complex_NP_yang", 90, [(93.2, 93.3, 0.1), (94.4, 95.6, 1.2), (95.4, 93.3, -2.1), (88.3, 87.8, -0.5)]),
    ("squad_id", "voice_meN", 32, [(92.9, 93.8, 0.9), (93.1, 96.9, 3.8), (93.4, 90.6, -2.8), (85.0, 90.6, 5.6)]),
    ("squad_id", "voice_di", 65, [(93.3, 90.8, -2.5), (93.8, 90.8, -3.0), (93.1, 93.8, 0.7), (85.5, 84.6, -0.9)]),
    ("squad_id", "reduplication", 4, [(92.9, 100.0, 7.1), (93.3, 100.0, 6.7), (93.1, 100.0, 6.9), (85.3, 100.0, 14.7)]),
    ("squad_id", "complex_NP_yang", 84, [(93.3, 91.7, -1.6), (93.5, 92.9, -0.6), (93.7, 90.5, -3.2), (84.8, 88.1, 3.3)]),
    ("tydiqa_sw", "noun_class_concord", 231, [(82.6, 86.6, 4.0), (87.2, 90.9, 3.7), (83.8, 88.7, 4.9), (72.5, 73.2, 0.7)]),
    ("tydiqa_sw", "passive", 11, [(84.9, 63.6, -21.3), (89.1, 81.8, -7.3), (86.2, 81.8, -4.4), (73.2, 54.5, -18.7)]),
    ("tydiqa_sw", "locative_ni", 63, [(85.2, 79.4, -5.8), (89.4, 85.7, -3.7), (86.6, 82.5, -4.1), (72.7, 73.0, 0.3)]),
    ("squad_sw", "noun_class_concord", 335, [(91.4, 93.1, 1.7), (93.3, 93.7, 0.4), (93.3, 93.7, 0.4), (74.8, 69.9, -4.9)]),
    ("squad_sw", "applicative", 1, [(92.6, 100.0, 7.4), (93.6, 100.0, 6.4), (93.6, 100.0, 6.4), (71.4, 100.0, 28.6)]),
    ("squad_sw", "passive", 30, [(92.5, 93.3, 0.8), (93.2, 100.0, 6.8), (93.6, 93.3, -0.3), (70.5, 86.7, 16.2)]),
    ("squad_sw", "locative_ni", 84, [(93.2, 89.3, -3.9), (93.7, 92.9, -0.8), (94.0, 91.7, -2.3), (71.5, 71.4, -0.1)]),
]


def _r1(k, n):
    return float(np.round(k / n * 100, 1))


def _reconstruct():
    """(dataset, phenomenon, model) -> (n_with, k_with, k_without); checks uniqueness."""
    out = {}
    for ds, ph, nw, rows in SLICES:
        for m, kt, (no, has, _) in zip(MODELS, K[ds], rows):
            cands = [k for k in range(nw + 1) if _r1(k, nw) == has]
            assert len(cands) == 1, (ds, ph, m, cands)
            kw = cands[0]
            assert _r1(kt - kw, N[ds] - nw) == no, (ds, ph, m)
            out[(ds, ph, m)] = (nw, kw, kt - kw)
    return out


def test_sixty_slice_rows(spark):
    rec = _reconstruct()
    assert len(rec) == 60
    # one "language" per (dataset, phenomenon): the joint distribution of tags is not published
    langs = tuple(LangSpec(f"{ds}:{ph}", ph, f"{ds}:{ph}", f"{ds}:{ph}#t", (ph,), ("general",))
                  for ds, ph, _, _ in SLICES)
    cfg = EvalConfig(langs=langs, models=MODELS)
    spec = spark.createDataFrame([(f"{ds}:{ph}", ph, m, N[ds], nw, kw, ko) for (ds, ph, m), (nw, kw, ko) in rec.items()],
                                 "lang string, ph string, model string, n int, nw int, kw int, ko int")
    cells = spec.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    has = F.col("i") < F.col("nw")
    correct = F.when(has, F.col("i") < F.col("kw")).otherwise(F.col("i") - F.col("nw") < F.col("ko"))
    tags = F.struct(F.when(has, F.array("ph")).otherwise(F.array().cast("array<string>")).alias("linguistic_phenomena"),
                    F.lit(None).cast("string").alias("paraphrase_distance"), F.lit(None).cast("string").alias("domain"))
    cells = cells.select(F.concat_ws("_", "lang", F.col("i").cast("string")).alias("id"), "lang",
                         F.col("lang").alias("dataset"), "model", F.lit("openbook").alias("condition"),
                         correct.alias("correct"), tags.alias("tags"))
    flat = R.flatten_all(cells, None, cfg)
    got = {(r.dataset, r.model): (r.n_with, r.acc_without, r.acc_with, r.delta)
           for r in S.accuracy_by_phenomenon(flat, cfg).collect()}
    assert len(got) == 60
    for ds, ph, nw, rows in SLICES:
        for m, (no, hs, delta) in zip(MODELS, rows):
            assert got[(f"{ds}:{ph}", m)] == (nw, no, hs, delta), (ds, ph, m)


# Class sizes (coverage reports) and published open-book
# accuracy per model (deepseek, gemini, gemma, llama) for every class.
CLASSES = {
    "indoqa": {
        "paraphrase_distance": {"literal_match": (209, (96.2, 97.1, 97.6, 93.3)),
                                "paraphrase": (283, (92.2, 94.0, 94.3, 85.9)),
                                "requires_inference": (8, (50.0, 50.0, 50.0, 37.5))},
        "domain": {"general": (261, (92.0, 93.5, 94.6, 87.0)),
                   "indonesian_geography": (30, (100.0, 100.0, 100.0, 96.7)),
                   "indonesian_history": (209, (93.8, 95.2, 94.7, 88.5))}},
    "squad_id": {
        "paraphrase_distance": {"literal_match": (166, (95.8, 95.8, 95.8, 91.0)),
                                "paraphrase": (317, (92.1, 92.4, 92.4, 82.3)),
                                "requires_inference": (16, (81.2, 87.5, 81.2, 87.5))},
        "domain": {"general": (495, (92.9, 93.3, 93.1, 85.3)),
                   "indonesian_geography": (3, (100.0, 100.0, 100.0, 100.0)),
                   "indonesian_history": (1, (100.0, 100.0, 100.0, 100.0))}},
    "tydiqa_sw": {
        "paraphrase_distance": {"literal_match": (118, (97.5, 99.2, 99.2, 83.1)),
                                "paraphrase": (305, (86.6, 92.8, 92.1, 76.7)),
                                "requires_inference": (73, (54.8, 56.2, 39.7, 39.7))},
        "domain": {"east_african_geography": (75, (86.7, 82.7, 86.7, 74.7)),
                   "east_african_history": (95, (88.4, 88.4, 87.4, 73.7)),
                   "general": (326, (82.8, 90.5, 85.6, 72.1))}},
    "squad_sw": {
        "paraphrase_distance": {"literal_match": (190, (95.8, 96.3, 96.3, 78.9)),
                                "paraphrase": (292, (91.4, 92.1, 92.5, 66.8)),
                                "requires_inference": (16, (75.0, 87.5, 81.2, 68.8))},
        "domain": {"east_african_geography": (5, (100.0, 100.0, 100.0, 80.0)),
                   "east_african_history": (63, (93.7, 85.7, 87.3, 69.8)),
                   "general": (430, (92.3, 94.7, 94.4, 71.6))}},
}


def test_paraphrase_and_domain_slices(spark):
    from slicekit.config import PILOT
    rows = []
    for ds, facets in CLASSES.items():
        for mi, m in enumerate(MODELS):
            ks = {}
            for facet, classes in facets.items():
                tot = 0
                for cls, (n, accs) in classes.items():
                    cands = [k for k in range(n + 1) if _r1(k, n) == accs[mi]]
                    assert len(cands) == 1, (ds, facet, cls, m, cands)
                    ks[(facet, cls)] = (n, cands[0])
                    tot += cands[0]
                assert tot == K[ds][mi], (ds, facet, m)  # the classes add up to the published total
            # items 0..N-1: paraphrase and domain classes assigned in blocks, correct answers first
            rows.append((ds, m, [(f, c, n, k) for (f, c), (n, k) in ks.items()]))
    recs = []
    for ds, m, spec in rows:
        para = [(c, n, k) for f, c, n, k in spec if f == "paraphrase_distance"]
        dom = [(c, n, k) for f, c, n, k in spec if f == "domain"]
        # two independent frames per (dataset, model): one per facet (joint distribution unknown)
        for facet, classes in (("p", para), ("d", dom)):
            i = 0
            for cls, n, k in classes:
                for j in range(n):
                    recs.append((f"{ds}-{facet}-{i}", ds, m, facet, cls, j < k))
                    i += 1
    df = spark.createDataFrame(recs, "id string, dataset string, model string, facet string, cls string, correct boolean")
    lang = F.when(F.col("dataset").isin("indoqa", "squad_id"), "id").otherwise("sw")
    tags = F.struct(F.array().cast("array<string>").alias("linguistic_phenomena"),
                    F.when(F.col("facet") == "p", F.col("cls")).alias("paraphrase_distance"),
                    F.when(F.col("facet") == "d", F.col("cls")).alias("domain"))
    cells = df.select("id", lang.alias("lang"), "dataset", "model", F.lit("openbook").alias("condition"),
                      "correct", tags.alias("tags"))
    flat = R.flatten_all(cells, None, PILOT)
    got_p = {(r.dataset, r.category, r.model): (r.n, r.accuracy) for r in S.accuracy_by_paraphrase(flat).collect()}
    got_d = {(r.dataset, r.category, r.model): (r.n, r.accuracy) for r in S.accuracy_by_domain(flat).collect()}
    for ds, facets in CLASSES.items():
        for facet, classes in facets.items():
            got = got_p if facet == "paraphrase_distance" else got_d
            for cls, (n, accs) in classes.items():
                for m, acc in zip(MODELS, accs):
                    assert got[(ds, cls, m)] == (n, acc), (ds, cls, m)
    assert len(got_p) == 48 and len(got_d) == 48
