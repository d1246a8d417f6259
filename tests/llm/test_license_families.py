"""Licence families on held-out wordings, wrapped lines and ordinary text, and the scan against a plain version."""

import random
import textwrap

import numpy as np
from test_operators import prose

from tracelake.llm import licenses


def held_out(rnd):
    """A notice of every template as documents write it: in other surroundings, with a word changed or left out."""
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for _ in range(6):
                words = text.split()
                if len(words) > 12:
                    words[rnd.randrange(len(words))] = "project"
                yield family, rnd.choice(["", "Copyright 2019 Some Firm. ", "* "]) + " ".join(words) + rnd.choice(["", " See the file for details."])


def plain_scan(text, model):
    """(family, probability) of one paragraph, or None, by the model's own numbers."""
    found = set(licenses.grams(text))
    z = (sum((model.vocabulary[g] for g in found if g in model.vocabulary), np.zeros(len(model.families))) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    at = int(p.argmax())
    return (model.families[at], float(p[at])) if at > 0 and p[at] >= model.min_probability and found & {g.split(" ")[0] for g in model.vocabulary} else None


def test_recall_and_precision_by_family(spark):
    rnd = random.Random(31)
    cases = list(held_out(rnd))
    rows = [(i, prose(rnd, 30) + ".\n\n" + ("\n".join(textwrap.wrap(text, 78)) if i % 2 else text) + "\n\n" + prose(rnd, 30) + ".") for i, (_, text) in enumerate(cases)]
    rows += [(10_000 + i, prose(rnd, 40) + ".\n" + rnd.choice(["the public library has a free license office", "all copies were sold without permission", "he kept the rights to the software version 3"]) + ".\n" + prose(rnd, 20)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.fit(licenses.background_sample(docs))
    got = {}
    for r in licenses.scan(docs, model).filter("confirmed").collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    right = {f: 0 for f in licenses.TEMPLATES}
    for i, (family, _) in enumerate(cases):
        right[family] += family in got.get(i, ())
    total = {f: sum(c == f for c, _ in cases) for f in right}
    assert all(right[f] >= 0.8 * total[f] for f in right), {f: (right[f], total[f]) for f in right}
    wrong = sum(f != cases[i][0] for i, found in got.items() if i < 10_000 for f in found)
    assert wrong <= 0.05 * len(cases) and sum(i >= 10_000 for i in got) <= 2


def test_scan_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(licenses.background_sample(docs))
    want = {}
    for r in licenses.paragraphs(docs).collect():
        found = plain_scan(r["text"], model)
        if found:
            want[r["doc_id"], r["paragraph"]] = found
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["probability"]) for r in licenses.scan(docs, model).collect()}
    assert got.keys() == want.keys() and got
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
