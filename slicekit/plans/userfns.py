"""Deterministic stand-ins for model calls used by the registered queries.

Kept in a module without import side effects: Spark pickles them by reference
and the Python workers import this module.
"""

from __future__ import annotations


def infer_fn(rec: dict) -> dict:
    """Answers with the model name and the question; a blank question cannot be answered."""
    if not rec["question"].strip():
        raise ValueError("blank question")
    return {"prediction": f"{rec['model']}:{rec['question']}"}


def judge_fn(rec: dict) -> dict:
    """Grades by the answer's number; an answer of under three digits is too short to judge."""
    number = rec["prediction"][4:]
    if len(number) < 3:
        raise ValueError(f"too short to judge: {rec['prediction']}")
    return {"verdict": "correct" if int(number) < 500 else "incorrect", "reason": f"{number} of 500"}


def surface_tag_fn(rec: dict) -> dict:
    """Tags a text by its surface; a blank one is refused."""
    import json
    t = rec["context"] or ""
    if not t.strip():
        raise ValueError("nothing to tag")
    signs = (("newline", "\n" in t), ("pipe", " | " in t), ("email", "@" in t), ("long", len(t) > 1500))
    return {"tags_json": json.dumps({"linguistic_phenomena": [p for p, hit in signs if hit]})}


def length_ratio_scorer(pdf):
    """A vectorised batch scorer: min(len) / max(len) of hypothesis and reference."""
    import numpy as np
    import pandas as pd
    h = pdf["hyp"].fillna("").str.len().to_numpy(dtype="float64")
    r = pdf["ref"].fillna("").str.len().to_numpy(dtype="float64")
    mx = np.maximum(h, r)
    score = np.where(mx > 0, np.minimum(h, r) / np.where(mx > 0, mx, 1.0), 0.0)
    return pd.DataFrame({"score": score, "batch_rows": np.full(len(pdf), len(pdf), dtype="int64")})


def translate_fn(rec: dict) -> dict:
    return {"question": rec["text"].split("\n")[0].strip(), "context": rec["text"]}


def locate_fn(rec: dict) -> dict:
    """The question's second word, found where the lines behind the question hold it."""
    words = rec["question"].split(" ")
    gold = words[1] if len(words) > 1 else ""
    return {"gold": gold, "span_found": bool(gold) and gold in rec["context"].partition("\n")[2]}


def rule_tag_fn(rec: dict) -> dict:
    """A tagger stand-in: tags from surface patterns; a text without a full stop has no sentence to tag."""
    import json
    t = rec["context"] or ""
    if "." not in t:
        raise ValueError("no sentence to tag")
    ph = [p for p, hit in (("newline", "\n" in t), ("pipe", " | " in t), ("email", "@" in t),
                           ("long", len(t) > 1500)) if hit]
    return {"tags_json": json.dumps({"linguistic_phenomena": ph})}
