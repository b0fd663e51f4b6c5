"""The sketch of longer runs holds only those whose pairs can be frequent."""

from collections import Counter

import numpy as np

from textloom.llm import phrases


def test_runs_of_rare_pairs_are_not_counted(spark):
    every = np.full(1 << phrases.FILTER_BITS - 3, 255, np.uint8)
    rows = [(i, f"a b c d e, {' '.join(f'x{(7 * i + j * j) % 50}' for j in range(60))}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frequent = spark.sparkContext.broadcast(every)
    bits = spark.sparkContext.broadcast(phrases.sketch(docs, frequent, 40, 2))
    text = " , ".join(t for _, t, _ in rows)
    words = text.split()
    pairs = Counter((a, b) for a, b in zip(words, words[1:], strict=False) if "," not in a + b)
    own = phrases._Runs("en", [text.encode()], every, bits.value)
    runs = {k: len(at) for k, at in own.begins(5)}
    assert runs[2] < sum(pairs.values()) and runs[2] >= sum(n for n in pairs.values() if n >= 40) >= 120
    longer = phrases.sketch(docs, frequent, 40, 5, bits)
    assert np.unpackbits(longer).sum() <= 2 * 10  # both rows: abc, bcd, cde, abcd, bcde, abcde, and few that fall together
    held = spark.sparkContext.broadcast(longer)
    found = phrases._source(docs).mapInArrow(phrases._find(frequent, bits, held, 5, False), "lang string, phrase string, n long").collect()
    assert {len(r.phrase.split()) for r in found} >= {2, 3, 4, 5}
