"""Token counts, token files and their codes against the libraries themselves."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slicekit.llm import dac
from slicekit.llm.counts import count_tokens
from slicekit.llm.token_files import read_token_files, token_file_digest, write_token_files
from slicekit.llm.tokens import PieceEncoder, tokenizer_path

from .helpers import EDGE_ROWS, documents, prose, with_clashes

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = tokenizer_path(request.param)
    return PieceEncoder(path), Tokenizer.from_file(path)


def _same(pair, texts):
    own, library = pair
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    flat, per = own.ids(texts)
    assert per.tolist() == list(map(len, want))
    assert flat.tolist() == [i for w in want for i in w]
    assert own.lengths(texts).tolist() == list(map(len, want))


def test_pieces_give_the_ids_of_whole_texts(pair):
    assert pair[0].pattern is not None
    rng = random.Random(1)
    _same(pair, [t for _, t in EDGE_ROWS] + [prose(rng, 30) for _ in range(20)])


_ODD = st.text(alphabet=st.sampled_from(list("abAB'st09.,-<|>_ \n\t\r\x0b\x1c\x1f\x85\xa0 　́\xe9\xdfж中\U0001f600&%")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(_ODD | st.text(max_size=20) | st.sampled_from(["<|endoftext|>", " <|endoftext|>", "a <|startoftext|>  b"]), max_size=6))
def test_pieces_on_random_texts(texts):
    for name in FILES:
        if name not in _PAIRS:
            _PAIRS[name] = PieceEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
        _same(_PAIRS[name], ["".join(texts), *texts])


_PAIRS: dict = {}


def test_the_piece_table_is_bounded(pair):
    own = PieceEncoder(tokenizer_path(FILES[0]), max_pieces=10)
    library = Tokenizer.from_file(tokenizer_path(FILES[0]))
    rng = random.Random(2)
    for _ in range(30):
        _same((own, library), [prose(rng, 3) + " the the the"])
        assert len(own.codes) < 200
    assert " the" in own.codes


def test_counts_of_every_row(spark):
    for name in FILES:
        library = Tokenizer.from_file(tokenizer_path(name))
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit)
                     for r in count_tokens(with_clashes(documents(spark, EDGE_ROWS)), name).collect())
        want = []
        for d, t in EDGE_ROWS:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want.append((str(d), len((t or "").encode()), n, n > 512))
        assert got == sorted(want)
    assert count_tokens(documents(spark, [])).count() == 0


def test_counts_by_sentencepiece(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = [r for r in EDGE_ROWS if r[1] is None or len(r[1]) < 1000]
    got = sorted((str(r.doc_id), r.n_tokens) for r in count_tokens(documents(spark, rows), "piece_bpe_32k.model").collect())
    assert got == sorted((str(d), len(library.encode(t or ""))) for d, t in rows)


@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300), max_size=2000), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_round_trip_and_random_access(ids, data):
    code = dac.Reader(dac.encode(np.array(ids, np.uint32)))
    assert len(code) == len(ids)
    assert code.slice(0, len(ids)).tolist() == ids
    if ids:
        a = data.draw(st.integers(0, len(ids)))
        b = data.draw(st.integers(a, len(ids)))
        assert code.slice(a, b).tolist() == ids[a:b]
        i = data.draw(st.integers(0, len(ids) - 1))
        assert code[i] == ids[i]


def test_a_long_code_is_read_at_any_place():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49408, 100_000).astype(np.uint32)
    code = dac.Reader(dac.encode(ids))
    for i in rng.integers(0, len(ids), 200).tolist():
        assert code[i] == ids[i] and code.slice(i, i + 700).tolist() == ids[i:i + 700].tolist()
    with pytest.raises(ValueError):
        dac.Reader(b"nonsense")


def test_token_files_hold_all_documents_in_order(spark, tmp_path):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = with_clashes(documents(spark, EDGE_ROWS))
    path = str(tmp_path / "files")
    write_token_files(docs, path, segment_tokens=100)
    assert spark.read.parquet(path).count() >= 3  # several segments
    want, at = [], 0
    for d, t in sorted(EDGE_ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in read_token_files(spark, path).orderBy("start").collect()] == want


def test_an_empty_table_gives_no_rows(spark):
    assert token_file_digest(documents(spark, [])).count() == 0
