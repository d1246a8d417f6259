"""A notice that many lines of the corpus hold is still found."""

import random

from test_operators import make, prose

from tracelake.llm import licenses


def test_common_notices_are_found(spark):
    rnd = random.Random(9)
    common = {0: ("Proprietary", "Copyright {} Firm. All rights reserved."), 1: ("CC0", "Dedicated to the public domain under CC0 1.0. {}"), 2: ("GPL-3.0", "Licensed under GPL-3.0. {}")}
    rows, want = [], {}
    for i in range(300):
        notice = prose(rnd, 9)
        if i < 90:
            family, line = common[i % 3]
            notice, want[i] = line.format(1900 + i), family
        rows.append((i, prose(rnd, 20) + "\n" + notice, "en", "a"))
    docs = make(spark, rows)
    model = licenses.fit(licenses.background_sample(docs))
    assert {"all rights", "rights reserved", "public domain"} <= set(model.vocabulary)
    got = [(r["doc_id"], r["family"], r["confirmed"]) for r in licenses.scan(docs, model).collect()]
    assert sorted(got) == [(i, family, True) for i, family in sorted(want.items())]
