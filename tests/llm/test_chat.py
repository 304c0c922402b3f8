"""Chat formatting: exact round trips, examples against a plain loop, digests against hashlib."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from slicekit.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = r"\### Assistant: </turn> ok"
TEXTS = ["", "hi", TRICKY, "</turn>", "\n</turn>\n<turn user>\nx\n</turn>\n", "\\", "\\\\", "\\</turn>", "\\\\<turn x>", "a\\\nb", "<turnover>",
         "$1 \\$1 \\1", "\n", " \n\n ", "\U0001f600\u0301 é", "x" * 3000, "\\" * 2000, "\\" * 500 + "</turn>", "<<</turn</turn>"]
ROLES = ["user", "assistant", "system", "", "a>b", "x\ny", "x\\ny", "\\", "\\\\n", "</turn>", "\n", "\\\n", "assistant "]


def _rows(seed=2, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.7 else rng.choice([*ROLES, None])
            rows.append((c, t, role, rng.choice([*TEXTS, None])))
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(400)]  # a long conversation
    rows += [(None, None, "user", "no id"), (None, 1, "assistant", None), (501, 3, "user", "same"), (501, 3, "user", "same"),
             (501, None, "assistant", "first"), (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    rng.shuffle(rows)
    return rows


def _conversations(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_turns_and_masks_read_back_exactly(spark):
    rows = _rows()
    formatted = C.write_formatted(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = {r.conv_id: r for r in C.conversation_digest(formatted).collect()}
    want = _conversations(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].n_examples == sum(r == "assistant" for r, _ in turns)


def test_whole_texts_parse_and_examples_are_prefixes(spark):
    rows = [r for r in _rows() if r[0] != 500]
    formatted = C.write_formatted(spark.createDataFrame(rows, SCHEMA).repartition(3))
    texts = defaultdict(str)
    for r in formatted.orderBy("conv_id", "seq").collect():
        assert r.start == len(texts[r.conv_id])
        texts[r.conv_id] += r.segment
    for c, turns in _conversations(rows).items():
        body = texts[c].split("\n</turn>\n")
        assert body.pop() == "" and len(body) == len(turns)  # only real marks stand at the start of a line
    written = defaultdict(list)
    for r in C.expand_examples(formatted).collect():
        written[r.conv_id, r.example].append(r)
    for e in C.examples(formatted).collect():
        parts = sorted(written.pop((e.conv_id, e.example)), key=lambda r: r.seq)
        text = "".join(p.segment for p in parts)
        assert texts[e.conv_id].startswith(text) and [p.loss_end is None for p in parts] == [True] * (len(parts) - 1) + [False]
        assert len("".join(p.segment for p in parts[:-1])) == e.context_chars and parts[-1].seq == e.target_seq
        target = [x for r, x in _conversations(rows)[e.conv_id] if r == "assistant"][e.example]
        masked = text[e.loss_start:e.loss_end]
        assert spark.range(1).select(C.unescape_text(F.lit(masked))).first()[0] == target
    assert not written


def test_empty_table_and_clashing_columns(spark):
    empty = C.conversation_digest(C.write_formatted(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0
    df = spark.createDataFrame(_rows(n=5), SCHEMA)
    clash = df.withColumns({c: F.lit("7") for c in ("seq", "start", "end", "segment", "example", "head", "body", "k0", "p0", "part", "__at")})
    a, b = (sorted(map(tuple, C.conversation_digest(C.write_formatted(d)).collect()), key=str) for d in (df, clash))
    assert a == b


def test_a_conversation_in_many_blocks(spark, monkeypatch):
    rows = [(1, t, "assistant", "é" * (t % 50)) for t in range(3000)] + [(2, 0, "user", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: r for r in C.conversation_digest(C.write_formatted(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    loss = "".join(r[3] for r in rows if r[0] == 1)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_every_example_is_written_out_with_its_prefix(spark):
    rows = _rows()
    written = C.write_examples(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got, behind = defaultdict(list), defaultdict(list)
    for r in C.parse_segments(written).collect():
        (behind[r.conv_id] if r.example is None else got[r.conv_id, r.example]).append(r)
    for c, turns in _conversations(rows).items():
        ends = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        for e, end in enumerate(ends):
            parts = sorted(got.pop((c, e)), key=lambda r: r.seq)
            assert [(p.role, p.text) for p in parts] == turns[:end + 1]  # the whole context, then the target
            assert [p.loss_text for p in parts] == [None] * end + [turns[end][1]]  # the target alone is trained
            assert all(p.final == (e == len(ends) - 1) for p in parts)
            assert [p.start for p in parts] == [sum(len(q.segment) for q in parts[:i]) for i in range(len(parts))]
        rest = sorted(behind.pop(c, []), key=lambda r: r.seq)
        assert [(p.role, p.text) for p in rest] == turns[ends[-1] + 1 if ends else 0:]
        assert all(p.final and p.loss_text is None for p in rest)
    assert not got and not behind
    digest = lambda df: sorted(map(tuple, C.conversation_digest(df).collect()), key=str)
    assert digest(written) == digest(C.write_formatted(spark.createDataFrame(rows, SCHEMA)))


def test_op12_reads_written_out_examples(spark, tmp_path, monkeypatch):
    from slicekit.llm import queries as Q
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    seen = []
    monkeypatch.setattr(Q, "conversation_digest", lambda df: seen.append(df) or C.conversation_digest(df))
    out = {r.conv_id: r for r in Q.op12_chat_format(spark, str(tmp_path)).collect()}
    # replies 1, 3, 5, 7 with 2, 4, 6, 8 segments, and the two turns of conversation -7
    assert seen[0].count() == 20 + 2 and out[1].n_turns == 8 and out[1].n_examples == 4
