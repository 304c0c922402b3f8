"""Decontamination against a plain scan of every window."""

import hashlib
import random
import re

import pytest

from slicekit.llm import decontam as D

from .helpers import EDGE_ROWS, documents, prose, with_clashes

ITEMS = "item_id long, text string"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _plain(rows, items, window=13):
    out = []
    for d, t in rows:
        words, hit, found = _words(t), set(), set()
        for item, text in items:
            w = _words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                g = w[i:i + window]
                for p in range(len(words) - len(g) + 1):
                    if words[p:p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        found.add("" if item is None else str(item))
        ids = ",".join(sorted(found))
        out.append((str(d), len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def _got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def _case(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(1, 5))) for i in range(12)]
    items += [(20, "Only three words"), (21, "again again again"), (22, None), (23, ""), (24, "--"), (25, items[0][1]),
              (None, "no id has this item"), (3, "a second text of item three"), (3, items[3][1])]
    rows = []
    for i in range(40):
        words = prose(rng, rng.randint(0, 30)).split()
        for _ in range(rng.randint(0, 2)):
            piece = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(len(piece) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece[a:] if rng.random() < 0.5 else piece
        rows.append((i, "  ".join(words)))
    rows += [(50, "Again, again! AGAIN again again"), (51, "only three words only three words"), (52, "only three"), (53, "x no id has this item")]
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_every_row_against_the_plain_scan(spark, seed):
    rows, items = _case(seed)
    rows = rows + [r for r in EDGE_ROWS if r[1] is None or len(r[1]) < 10_000] + rows[:3]
    bench = with_clashes(spark.createDataFrame(items, ITEMS)).drop("item_id")
    bench = spark.createDataFrame(items, ITEMS).repartition(2) if "item_id" not in bench.columns else bench
    got = _got(D.contamination(with_clashes(documents(spark, rows)), bench))
    assert got == _plain(rows, items)
    assert any(g[5] for g in got) and any(g[2] and not g[5] for g in got)


def test_passes_and_an_index_of_all_words_change_nothing(spark, monkeypatch):
    rows, items = _case(3)
    bench = spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(D, "VOCABULARY_BYTES", 10)
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    many = D.phrase_matches(documents(spark, rows), bench, windows_per_pass=7)
    monkeypatch.setattr(D, "phrase_matches", lambda *a, **k: many)
    assert _got(D.contamination(documents(spark, rows), bench)) == _plain(rows, items)


def test_empty_tables(spark):
    rows, items = _case(1)
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination(documents(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in D.contamination(documents(spark, rows), none).collect())
    assert D.drop_contaminated(documents(spark, rows), none).count() == len(rows)


def test_the_stage_drops_contaminated_rows_only(spark):
    rows, items = _case(2)
    rows = rows + [(None, None), (None, items[1][1]), (7, items[2][1]), (7, "clean words")]
    docs = with_clashes(documents(spark, rows))
    kept = D.drop_contaminated(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns
    want = [r for r in rows if not _plain([r], items)[0][5]]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(d), str(t)) for d, t in want)


def test_proximity(spark):
    rows = [(1, "zeta one two three four alpha five six beta"), (2, "zeta " + "pad " * 50 + "alpha beta gamma"),
            (3, "beta alpha zeta gamma zeta"), (4, None), (5, "zeta alpha"), (6, "beta alpha")]
    items = [(1, "alpha beta zeta"), (2, None)]
    got = D.proximity_matches(documents(spark, rows), spark.createDataFrame(items, ITEMS), n_rarest=3, span=10)
    # the rarest of the three is any of them with the fewest places: zeta 5, alpha 5, beta 4
    assert sorted((r.doc_id, r.item_id, r.place) for r in got.collect()) == [(1, "1", 8), (3, "1", 0)]


def test_proximity_with_words_the_corpus_lacks(spark):
    rows = [(1, "zeta one two three alpha five six beta gamma"), (2, "zeta pad alpha pad pad"), (3, "other words other")]

    def found(item, **how):
        got = D.proximity_matches(documents(spark, rows), spark.createDataFrame([(1, item)], ITEMS), span=10, **how)
        return sorted({r.doc_id for r in got.collect()})

    assert found("alpha beta zeta") == [1]
    assert found("alpha beta zeta unheardof") == [1]  # one unknown word hides nothing
    assert found("alpha beta zeta un1 un2 un3 un4") == []  # most words unknown: no match
    assert found("alpha unheardof") == [1, 2] and found("unheardof") == []
    # beta, the rarest with gamma, must be there; three of the four suffice
    assert found("beta gamma alpha other", share=0.75) == [1] and found("beta gamma alpha other") == []
